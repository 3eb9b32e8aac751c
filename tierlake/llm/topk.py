"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors lie in blocks of bounded size. Each block has, per dimension, its vectors sorted by that
dimension's value; the blocks with their lists are built once and written. For a query the lists
are read from the end that scores highest (largest values where the query's component is positive,
smallest where it is negative), a few entries at a time of those lists whose last entries lowered
the bound most; vectors met for the first time are scored in full. No vector that has not been met
can score more than the sum, over dimensions, of the query's component times the value last read,
so reading stops when that bound is below the k-th best score; at equality it goes on, because of
ties. A task carries its queries' k best from block to block, so that a later block starts with
their bound. The tasks' k best per query are merged by rank.

Queries go to the blocks in rounds of bounded size, and only results are shuffled. Where vectors
have no preferred direction the bound falls late: with 64 such dimensions nearly all vectors are met
before it does, and the work is that of scoring every vector for every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, saved, shared_path, table

#: Components of queries that are broadcast in one round (8 bytes each).
ROUND = 4 << 20
_NONE = np.empty(0, np.int64)


class SortedLists:
    """A block of integer vectors with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray | None = None):
        if lists is None:
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)  # column d: rows by rising value of d
        self.ids, self.vectors, self.lists = ids, vectors, lists
        self.met = 0  # vectors scored so far, over all queries

    def top(self, query: np.ndarray, own: int, k: int, step: int = 32, wide: int = 16, best: list[tuple[int, int]] = []) -> list[tuple[int, int]]:
        """The k best (score, id) of the block without one row of id ``own`` equal to the query, and of ``best``, ties to smaller ids; fewer if there are fewer."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        weight = query[dims]
        down = weight > 0
        met = np.zeros(n, bool)
        low, high = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        met[low + np.flatnonzero((self.vectors[low:high] == query).all(1))[:1]] = True
        left = n - int(met.sum())
        score, ids = (np.array(x, np.int64) for x in zip(*best)) if best else (_NONE, _NONE)
        depth = np.zeros(len(dims), np.int64)
        # the largest that a list's next entry can add, and by how much its last entries lowered that
        reach = np.where(down, self.vectors[self.lists[-1, dims], dims], self.vectors[self.lists[0, dims], dims]) * weight if n else weight
        fall = np.full(len(dims), np.iinfo(np.int64).max)
        while left and len(dims):
            if len(score) == k and int(reach.sum()) < score[-1]:
                break
            some = np.argsort(-fall, kind="stable")[:wide]
            at = depth[some, None] + np.arange(step)
            at = np.minimum(at, n - 1)
            rows = self.lists[np.where(down[some, None], n - 1 - at, at), dims[some, None]]
            depth[some] = np.minimum(depth[some] + step, n)
            now = self.vectors[rows[:, -1], dims[some]] * weight[some]
            fall[some], reach[some] = np.where(depth[some] < n, reach[some] - now, -1), now
            fresh = rows[~met[rows]]
            if len(fresh):
                fresh = np.unique(fresh)
                met[fresh] = True
                left -= len(fresh)
                self.met += len(fresh)
                got = self.vectors[fresh] @ query
                if len(score) == k:
                    fresh, got = fresh[got >= score[-1]], got[got >= score[-1]]
                if len(fresh):
                    score, ids = np.concatenate((score, got)), np.concatenate((ids, self.ids[fresh]))
                    keep = np.lexsort((ids, -score))[:k]
                    score, ids = score[keep], ids[keep]
        if left and not len(dims):  # a query of zeros has no list to read: all scores are 0
            rest = np.flatnonzero(~met)[:k]
            score, ids = np.concatenate((score, np.zeros(len(rest), np.int64))), np.concatenate((ids, self.ids[rest]))
            keep = np.lexsort((ids, -score))[:k]
            score, ids = score[keep], ids[keep]
        return list(zip(score.tolist(), ids.tolist()))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block: int = 4096, group: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest integer inner product.

    Components x become floor(scale * x), x as double; scores are exact while they fit a long.
    Candidates are all rows of ``vectors`` but one of the query's id and vector, which is the query's
    own row; ties go to the smaller id. Every row counts: rows of one id are queries and candidates of
    their own, and an equal row beside the query's own one is a candidate. Rows whose id or vector is
    null, or whose vector holds a null or non-finite component, take no part, as query or candidate.
    Vectors of fewer components than others count as filled with zeros. Other columns are not read; an
    empty side gives no rows. ``block`` vectors are a block; at most ``group`` queries, and ROUND components
    of them, are a round, which is the only data that is collected and broadcast.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
        fit = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fit)
        return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    # equal rows are counted first: k of them and the query's own can matter, and equal queries have equal results
    alike = lambda df: clean(df).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1))))
    cand = checkpointed(alike(vectors).select("id", "v", copies.alias("copy")).drop("copy"))
    ask = checkpointed(alike(queries).withColumn("q", F.monotonically_increasing_id()))
    many, width = cand.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked, wider = ask.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, wider or 0, 1)
    blocks = max(1, -(-many // block))
    group = max(1, min(group, ROUND // width))

    def filled(col: pd.Series) -> np.ndarray:
        return np.array([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in col]).reshape(len(col), width)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = SortedLists(part["id"].to_numpy(), filled(part["v"]))
        return pd.DataFrame({"ids": [made.ids.tobytes()], "vectors": [made.vectors.tobytes()], "lists": [made.lists.tobytes()]})

    tasks = min(blocks, max(2 * spark.sparkContext.defaultParallelism, blocks // 16))
    cand = cand.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).repartition(tasks, "b")
    built = saved(cand.groupBy("b").applyInPandas(build, "ids binary, vectors binary, lists binary"), "blocks")
    ask = checkpointed(ask.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-asked // group)))).cast("int")))
    out = shared_path(spark, "top")
    kind = "q long, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(out)
    for g in range(-(-asked // group)):
        rows = ask.where(F.col("g") == g).select("q", "id", "v").toPandas()  # about ``group`` queries
        sent = spark.sparkContext.broadcast((rows["q"].tolist(), rows["id"].tolist(), filled(rows["v"])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, ids, asks = sent.value
            best: list[list[tuple[int, int]]] = [[] for _ in ids]
            for batch in batches:
                for own, flat, lists in zip(*(c.to_pylist() for c in batch.columns)):
                    here = SortedLists(np.frombuffer(own, np.int64), np.frombuffer(flat, np.int64).reshape(-1, width), np.frombuffer(lists, np.int32).reshape(-1, width))
                    for i, query in enumerate(asks):
                        best[i] = here.top(query, ids[i], k, best=best[i])
            found = [(i, v, s) for i, b in zip(numbers, best) for s, v in b]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["q", "vec_id", "score"])

        arrow_map(built, search, kind).write.mode("append").parquet(out)
        sent.unpersist()
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")  # k rows of a query for each task at most
    parts = spark.read.schema(kind).parquet(out)
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(ask.select("q", F.col("id").alias("query_id"), "n"), "q")
    each = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")  # once for every equal query row
    return named.select("query_id", "rank", "vec_id", "score", each).drop("copy")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = {
    "op10_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}

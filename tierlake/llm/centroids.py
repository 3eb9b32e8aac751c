"""Centroid clustering with Drake's adaptive bounds, in exact integers.

Every vector keeps the numbers of its several nearest centroids, nearest first, a lower bound of its
distance to each of them, one bound for all centroids that remain, and an upper bound of its
distance to its own centroid. When the centroids have moved, bounds move by as much. A vector whose upper
bound is below all its lower bounds stays where it is without any distance computed. Else the
distance to its own centroid is computed, then those to its several nearest ones; if the nearest of
these cannot be told to be before all that remain, all centroids are scanned. Bounds are floating
point with a margin far above their rounding; where they leave a doubt, and in every tie, exact
integer distances decide. The number of near centroids kept adapts: a round counts how many bounds were
passed at most, and the next keeps as many, between an eighth and a quarter of all centroids.

Vectors lie in blocks with their bounds, written once a round, and the round before is deleted.
Centroids are the only data that is broadcast. A block's sums are added up per task, then by cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, dropped, saved, table

#: Vectors of a block, and the largest absolute component for which squared distances of 64 components fit a long.
BLOCK, LARGEST = 8192, 1 << 27
_STATE = ["ids", "vectors", "near", "low", "rest", "upper"]
_KIND = "ids binary, vectors binary, near binary, low binary, rest binary, upper binary, counts binary, sums binary, passed int"


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid, as integers."""
    most = max([1, *(int(np.abs(x).max()) for x in (vectors, centroids) if x.size)])
    kind = np.float64 if 4 * most * most * vectors.shape[1] < 1 << 53 else np.int64  # float products are exact so far, and faster
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def _pairs(vectors: np.ndarray, centroids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to its own row of centroids, as integers."""
    out = np.empty(near.shape, np.int64)
    for z in range(near.shape[1]):
        gap = vectors.astype(np.int64) - centroids[near[:, z]]
        out[:, z] = (gap * gap).sum(1)
    return out


#: Bounds are moved by this share of the distances so that rounding can never certify a wrong order.
MARGIN = 1e-9


class Bounds:
    """The vectors of a block with their bounds. ``scanned`` counts vectors whose distance to all centroids was computed, ``computed`` distances."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray, upper: np.ndarray):
        self.vectors, self.near, self.low, self.rest, self.upper = vectors, near, low, rest, upper
        self.scanned = self.computed = self.passed = 0

    @classmethod
    def first(cls, vectors: np.ndarray, centroids: np.ndarray, keep: int) -> Bounds:
        n = len(vectors)
        made = cls(vectors, np.zeros((n, keep), np.int32), np.zeros((n, keep)), np.zeros(n), np.zeros(n))
        made._scan(np.arange(n), centroids)
        return made

    def _scan(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        if not len(rows):
            return
        exact = _exact(self.vectors[rows], centroids)
        self.scanned += len(rows)
        self.computed += exact.size
        order = np.argsort(exact, axis=1, kind="stable")  # ties: the smaller number first
        ranked = np.sqrt(np.take_along_axis(exact, order, 1))
        keep = self.near.shape[1]
        self.near[rows], self.low[rows] = order[:, :keep], ranked[:, :keep] * (1 - MARGIN)
        self.rest[rows] = ranked[:, keep] * (1 - MARGIN) if keep < ranked.shape[1] else np.inf
        self.upper[rows] = ranked[:, 0] * (1 + MARGIN)

    def move(self, old: np.ndarray, new: np.ndarray) -> None:
        """Assign all vectors again after the centroids have moved."""
        gap = (new - old).astype(np.float64)
        drift = np.sqrt((gap * gap).sum(1)) * (1 + MARGIN)
        self.upper += drift[self.near[:, 0]]
        self.low -= drift[self.near]
        self.rest -= drift.max(initial=0)
        others = lambda rows: np.minimum(self.low[rows, 1:].min(1, initial=np.inf), self.rest[rows])
        open_rows = np.arange(len(self.vectors))
        open_rows = open_rows[self.upper >= others(open_rows)]
        if not len(open_rows):
            return
        own = np.sqrt(_pairs(self.vectors[open_rows], new, self.near[open_rows, :1])[:, 0])
        self.computed += len(open_rows)
        self.upper[open_rows], self.low[open_rows, 0] = own * (1 + MARGIN), own * (1 - MARGIN)
        open_rows = open_rows[self.upper[open_rows] >= others(open_rows)]
        if not len(open_rows):
            return
        # how many of the near ones' bounds the upper bound passes at most
        self.passed = int((self.upper[open_rows, None] >= self.low[open_rows]).sum(1).max())
        exact = _pairs(self.vectors[open_rows], new, self.near[open_rows])
        self.computed += exact.size
        order = np.lexsort((self.near[open_rows], exact), axis=1)
        near, ranked = np.take_along_axis(self.near[open_rows], order, 1), np.sqrt(np.take_along_axis(exact, order, 1))
        told = ranked[:, 0] * (1 + MARGIN) < self.rest[open_rows]
        rows = open_rows[told]
        self.near[rows], self.low[rows], self.upper[rows] = near[told], ranked[told] * (1 - MARGIN), ranked[told, 0] * (1 + MARGIN)
        # near centroids may now lie behind the rest, whose bound holds for the rest alone
        self._scan(open_rows[~told], new)

    def narrow(self, keep: int) -> None:
        """Keep fewer near centroids; the others join those that remain."""
        if keep < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, keep:].min(1))
            self.near, self.low = self.near[:, :keep].copy(), self.low[:, :keep].copy()

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(self.near[:, 0], minlength=k)
        out = np.zeros((k, self.vectors.shape[1]), np.int64)
        np.add.at(out, self.near[:, 0], self.vectors)
        return counts.astype(np.int64), out


def _clean(vectors: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    fit = (F.size(vec_col) == size) & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def _blocks(rows: DataFrame, size: int, centroids: np.ndarray, keep: int) -> DataFrame:
    """The vectors of each task in blocks, with their first bounds and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat = batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, size)
            for at in range(0, batch.num_rows, BLOCK):
                part = flat[at : at + BLOCK]
                if np.abs(part).max(initial=0) > LARGEST:
                    raise OverflowError(f"a scaled component is beyond {LARGEST}: squared distances would not fit a long")
                yield _row(ids.slice(at, BLOCK), Bounds.first(part.astype(np.int32), centroids, keep), len(centroids))

    return arrow_map(rows, run, _KIND)


def _row(ids: pa.Array | bytes, b: Bounds, k: int) -> pa.RecordBatch:
    if not isinstance(ids, bytes):
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.concat_arrays([ids])], names=["id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        ids = sink.getvalue().to_pybytes()
    counts, sums = b.sums(k)
    held = [ids, b.vectors.tobytes(), b.near.tobytes(), b.low.tobytes(), b.rest.tobytes(), b.upper.tobytes(), counts.tobytes(), sums.tobytes()]
    names = [part.split()[0] for part in _KIND.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in held), pa.array([b.passed], pa.int32())], names=names)


def _read(row: dict, size: int) -> Bounds:
    upper = np.frombuffer(row["upper"]).copy()
    n = len(upper)
    shaped = lambda name, kind: np.frombuffer(row[name], kind).reshape(n, -1).copy()
    return Bounds(np.frombuffer(row["vectors"], np.int32).reshape(n, size), shaped("near", np.int32), shaped("low", np.float64), np.frombuffer(row["rest"]).copy(), upper)


def _moved(blocks: DataFrame, size: int, old: np.ndarray, new: np.ndarray, keep: int) -> DataFrame:
    """One more round over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(_STATE)}
                b = _read(row, size)
                b.narrow(keep)
                b.move(old, new)
                yield _row(row["ids"], b, len(new))

    return arrow_map(blocks.select(*_STATE), run, _KIND)


def _centroids(blocks: DataFrame, old: np.ndarray) -> tuple[np.ndarray, int]:
    """The componentwise floors of the means, empty clusters as they were, and the most bounds that any vector passed."""
    k, size = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), object)  # Python's integers, which cannot overflow
        passed = 0
        for batch in batches:
            for counts, sums, p in zip(*(c.to_pylist() for c in batch.columns)):
                total[:, 0] += np.frombuffer(counts, np.int64)
                total[:, 1:] += np.frombuffer(sums, np.int64).reshape(k, size)
                passed = max(passed, p)
        where = [(c, d, str(total[c, d])) for c in range(k) if total[c, 0] for d in range(size + 1)]
        kinds = (pa.int32(), pa.int32(), pa.string())
        columns = [pa.array([w[j] for w in where], kind) for j, kind in enumerate(kinds)] + [pa.array([passed] * len(where), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "d", "total", "passed"])

    parts = arrow_map(blocks.select("counts", "sums", "passed"), run, "c int, d int, total string, passed int")
    added = parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("passed").alias("passed")).collect()  # k * (size + 1) rows at most
    found = {(r["c"], r["d"]): int(r["total"]) for r in added}
    new = old.copy()
    for c in range(k):
        if (c, 0) in found:
            new[c] = [found[c, d + 1] // found[c, 0] for d in range(size)]
    return new, max((r["passed"] for r in added), default=0)


def seed_order(id_col: str) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector after ``rounds`` rounds and a last assignment, and the centroids.

    Vectors with exactly ``size`` components, none null or non-finite, take part, with components x as
    floor(scale * x), x as double. Centroids start as the ``k`` vectors of least seed hash of their
    id, in that order; of equal hashes the smaller vector first; null ids, which have no hash, come last. Fewer
    vectors than ``k`` make as many centroids. Equal distances go to the smaller number; an empty cluster keeps its
    centroid. ``distance`` is squared. Rows of one id and equal rows count each for itself, other columns are not
    read, and an empty table gives no rows and no centroids. A scaled component beyond 2 ** 27 in
    magnitude raises OverflowError, as squared distances would not fit a long.
    """
    rows = _clean(vectors, id_col, vec_col, size, scale)
    first = rows.orderBy(seed_order("id").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), np.zeros((0, size), np.int64)
    if any(abs(x) > LARGEST for r in first for x in r["v"]):
        raise OverflowError(f"a scaled component is beyond {LARGEST}: squared distances would not fit a long")
    at = np.array([r["v"] for r in first], np.int64)
    most, least = max(1, -(-len(at) // 4)), max(1, len(at) // 8)
    keep = most
    blocks = saved(_blocks(rows, size, at, keep), "clusters")
    for _ in range(rounds):
        new, passed = _centroids(blocks, at)
        keep = max(least, min(keep, passed or keep))
        now = saved(_moved(blocks, size, at, new, keep), "clusters")
        dropped(blocks)
        blocks, at = now, new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(_STATE)}
                b = _read(row, size)
                ids = pa.ipc.open_stream(row["ids"]).read_all()["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.near[:, 0], pa.int32()), pa.array(_pairs(b.vectors, at, b.near[:, :1])[:, 0])], names=["id", "cluster", "distance"])

    return arrow_map(blocks.select(*_STATE), run, f"id {kind}, cluster int, distance long"), at


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = cluster(table(spark, sf_dir, "embeddings"))
    if not len(at):
        return found.select(F.col("id").alias("vec_id"), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    of = lambda values: F.array(*[F.lit(v) for v in values])[F.col("cluster")]
    inertia = [F.lit(sums.get(c, 0)).cast("long") for c in range(len(at))]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.array(*inertia)[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"),
    )


def _sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    squared = "CAST(list_sum([(v.e[j] - c.e[j]) * (v.e[j] - c.e[j]) FOR j IN range(1, %d)]) AS BIGINT)" % (size + 1)
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c, e FROM v
  QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.r, c.c, {squared} AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT c, list(m ORDER BY j) AS e FROM (
  SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
    SELECT a.m.c AS c, j, sum(v.e[j]) AS s, count(*) AS n FROM v JOIN a{i} a USING (r), range(1, {size + 1}) t(j) GROUP BY a.m.c, j)) GROUP BY c) n USING (c))""")
    return f"""
WITH {", ".join(parts)}
SELECT v.vec_id, CAST(a.m.c AS INT) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.m.c
"""


ORACLE_SQL = {"op13_centroids": _sql()}

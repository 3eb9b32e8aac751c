import math

import duckdb
import numpy as np
import pytest

from tierlake.llm import topk


def brute(cands, queries, k):
    def clean(rows):
        fit = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        return [(i, [math.floor(1024 * x) for x in v]) for i, v in fit]

    c, q = clean(cands), clean(queries)
    out = []
    for own in q:
        rest = list(c)
        if own in rest:
            rest.remove(own)
        s = sorted((-sum(a * b for a, b in zip(own[1], w)), j) for j, w in rest)[:k]
        out += [(own[0], r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(4096, 4096), (7, 3)])
def test_brute_force(spark, block, group):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # one very common vector
    rows += [(200, [0.0] * 6), (201, None), (202, [1.0, None] * 3), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, rows[0][1])]
    rows += [(205, []), (206, [2.0]), (5, rows[6][1]), (7, rows[7][1])]
    rows += [(6, rows[8][1]), (9, rows[9][1])] + [(300, rows[1][1])] * 25  # rows of one id, equal and not
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, g string, b int")
    exact = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = [r for r in exact if r[0] is None or r[0] % 3 == 0 or r[0] >= 200]
    got = topk.top_k(df, df.where("vec_id is null or vec_id % 3 = 0 or vec_id >= 200"), k=10, block=block, group=group)
    assert sorted(map(tuple, got.collect())) == brute(exact, asked, 10)
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0


def test_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-5, 5, (4000, 4))
    vectors[17] = 1000
    index = topk.SortedLists(np.arange(4000), vectors)
    assert index.top(np.array([1, 2, 3, 4]), -1, 1, step=1) == [(10000, 17)]


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(topk.ORACLE_SQL["op10_topk"]).fetchall())
    assert want and sorted(map(tuple, topk.op10_topk(spark, sf).collect())) == want


def test_bound_of_earlier_blocks():
    """A good bound from elsewhere ends the reading before all vectors are met."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (4000, 8))
    query = np.array([40, 30, 0, -20, 5, 1, 1, -1])
    score = vectors @ query
    order = np.lexsort((np.arange(4000), -score))[:10]
    want = list(zip(score[order].tolist(), order.tolist()))
    alone, led = (topk.SortedLists(np.arange(4000), vectors) for _ in range(2))
    assert alone.top(query, -1, 10) == want
    assert led.top(query, -1, 10, best=[(10**6, -i) for i in range(10, 0, -1)]) == [(10**6, -i) for i in range(10, 0, -1)]
    assert led.met == 0 and 0 < alone.met < 4000

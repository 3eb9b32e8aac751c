import hashlib
import math

import duckdb
import numpy as np
import pytest

from tierlake.llm import centroids


def brute(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [v for _, v in sorted(kept, key=seed)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                at[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, j, d) for i, v in kept for d, j in [nearest(v)]), key=str), at


@pytest.mark.parametrize("k,rounds,size,spread", [(16, 3, 8, 1.0), (5, 6, 3, 3.0), (16, 4, 2, 0.02), (1, 2, 4, 1.0), (40, 5, 4, 1.0)])
def test_brute_force(spark, k, rounds, size, spread, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = np.random.default_rng(k)
    rows = [(i, (spread * rng.normal(size=size) + (i % 3)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[4][1]) for i in range(60)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[8][1])]
    rows += [(500, None), (501, []), (502, [1.0] * (size + 1)), (503, [float("nan")] * size), (504, [float("inf")] * size), (505, [None] * size), (506, [0.0] * size)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int, id int").repartition(5)
    got, at = centroids.cluster(df, k, rounds, size, 64)
    want, want_at = brute(rows, k, rounds, size, 64)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert at.tolist() == want_at


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 1, 1, 3, -1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, at = centroids.cluster(df, 4, 3, 1, 64)
    want, want_at = brute(rows, 4, 3, 1, 64)
    assert sorted(map(tuple, got.collect()), key=str) == want and at.tolist() == want_at


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(3, [1.5, -0.01]), (4, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got, at = centroids.cluster(df, 16, 3, 2, 64)
    assert sorted(r[2] for r in got.collect()) == [0, 0] and sorted(at.tolist()) == [[96, -1], [128, 128]]
    got, at = centroids.cluster(df.limit(0), 16, 3, 2, 64)
    assert got.collect() == [] and at.shape == (0, 2)


@pytest.mark.parametrize("x", [1e300, -3e7])
def test_too_large(spark, x):
    df = spark.createDataFrame([(i, [x if i == 3 else 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df, 2, 1, 1, 64)[0].collect()


def test_bounds_spare_distances():
    """Drifting centroids: assignments are exact, most vectors are not scanned, and fewer near ones can be kept."""
    rng = np.random.default_rng(5)
    at = rng.integers(-3000, 3000, (24, 6))
    vectors = (at[rng.integers(0, 24, 4000)] + rng.integers(-300, 300, (4000, 6))).astype(np.int32)
    b = centroids.Bounds.first(vectors, at, 6)
    assert b.scanned == 4000
    for step, keep in enumerate([6, 5, 4, 3, 3]):
        new = at + rng.integers(-60, 60, at.shape)
        b.narrow(keep)
        b.move(at, new)
        at = new
        assert (b.near[:, 0] == centroids._exact(vectors, at).argmin(1)).all(), step
        assert 0 <= b.passed <= keep
    assert b.scanned < 8000 and b.computed < 4000 * 24 * 3


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(centroids.ORACLE_SQL["op13_centroids"]).fetchall())
    assert want and sorted(map(tuple, centroids.op13_centroids(spark, sf).collect())) == want


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0

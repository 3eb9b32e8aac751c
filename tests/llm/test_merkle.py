import hashlib
import zlib

import duckdb
import pytest

from tierlake.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, g string, i int, n int, path string, root string, part int, digest string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def tree(digests, fan):
    """Of each node its path, and the top."""
    paths, at = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [digests[i : i + fan] for i in range(0, len(digests), fan)]
        for i, members in enumerate(at):
            run, own = runs[i // fan], i % fan
            for m in members:
                paths[m].append(("".join(run[:own]), "".join(run[own + 1 :])))
        at = [sum(at[i : i + fan], []) for i in range(0, len(at), fan)]
        digests = [h("".join(r)) for r in runs]
    return paths, digests[0] if digests else None


def brute(rows, fan=16):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources]
    trees = [tree([leaf(r, r[1]) for r in g], fan) for g in groups]
    above, root = tree([t for _, t in trees], fan)
    out = []
    for g, (paths, sub), up in zip(groups, trees, above):
        for r, path in zip(g, paths):
            path = path + up
            lower = None if r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
            at = leaf(r, lower if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1])
            for before, after in path:
                at = h(before + at + after)
            out.append((r[0], leaf(r, r[1]), sub, root, h("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=str)


def table(n=700):
    rows = [(i, f"Text {i} é" * (i % 4), ["de", None, "en"][i % 3], ["web", "web", "news", "Ünion", "z"][i % 5], i) for i in range(n)]
    rows += [(None, "Null id", "en", "web", None), (None, None, None, None, None), (n, "Alone", "en", "", 3), (n + 1, "", "", None, 0)]
    rows += [(5, "Again", "en", "news", 1), (5, "again", "en", "news", 1)] + [(7, "Same", "en", "news", 4)] * 40 + [(n + 2, "A" * 100_000, "en", "x", 9)]
    rows += [(1000 + i, "One of many", "en", f"s{i}", 2) for i in range(20)]
    return rows


@pytest.mark.parametrize("fan", [16, 3])
def test_brute_force(spark, tmp_path, fan, monkeypatch):
    rows = table()
    df = spark.createDataFrame([(*r, "x", 1, 2, "p", "r", 0, "d") for r in rows], KIND)  # and columns of names that are used inside
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    real = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: real(*a, fan_out=fan, **k))
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, fan)
    assert {r["verified"] for r in got} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, "A", "en", "web", 1)]), ("groups", [(1, "a", "en", None, 1), (2, "b", "en", "", 1)])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = merkle.op11_merkle(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows), name


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(merkle.ORACLE_SQL["op11_merkle"]).fetchall())
    assert len(want) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(map(tuple, merkle.op11_merkle(spark, sf).collect())) == want

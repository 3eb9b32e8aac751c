import hashlib
import random
import re

import duckdb
import pytest

from tierlake.llm import substring


def cut(text, gone):
    """The text without some words and the blanks before them; at its ends without those on both sides."""
    parts = re.findall("([\x20\x09-\x0d]*)([^\x20\x09-\x0d]+)", text)
    out = ""
    for i, (blanks, word) in enumerate(parts):
        if i not in gone:
            out += word if not out and i else blanks + word
    last = re.search("[\x20\x09-\x0d]*$", text).group()
    return text if not gone else out + (last if len(parts) - 1 not in gone else "")


def brute(rows, length=20, spaced=False):
    """rows: (doc_id, text); ids in order, None first."""
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    rank = lambda d: (d is not None, d or 0)
    first = {}
    for d, w in split:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, ((2, 0), 0)), (rank(d), p))
    out = []
    for (d, w), (_, t) in zip(split, rows):
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (rank(d), p):
                gone.update(range(p, p + length))
        out.append((d, len(w), len(gone), cut(t or "", gone) if spaced else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["ä", "the", "of", *(f"w{i}" for i in range(40))]
    passage = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 60))) for _ in range(5)]
    out = [(None, passage[0]), (None, passage[0] + " tail"), (5, None), (6, ""), (7, " \n\t "), (8, "a " * 300), (9, "a " * 30 + "b"), (10, passage[1]), (10, passage[1]), (10, "x " + passage[1])]
    for i in range(20, 60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 30))) for _ in range(3)]
        out.append((i, f"{parts[0]} {r.choice(passage)}  {parts[1]}\n{r.choice(passage)}\x0b{parts[2]}"))
    return out + [(61, out[20][1]), (62, out[20][1])]


@pytest.mark.parametrize("batches,max_runs,shift", [(1, 4, 0), (2, 4, 0), (4, 1, 0), (2, 4, -30), (2, 4, 1 << 40)])
def test_brute_force(spark, rows, batches, max_runs, shift):
    rows = [(d if d is None else d + shift, t) for d, t in rows]
    docs = spark.createDataFrame([(*x, "k", 1, "h") for x in rows], "doc_id long, text string, key string, rest int, hot string")
    assert got(substring.deduplicate(docs, batches=batches, max_runs=max_runs)) == brute(rows)


def test_blanks_stay(spark, rows):
    run = " ".join(f"r{i}" for i in range(25))
    more = [(70, f"\n {run}\n\nnext\tline "), (71, f"first\r\n  line\n\n{run}  \n"), (72, f" a\n{run}\x0b é\x85b {run}\n"), (73, f" {run} ")]
    docs = spark.createDataFrame(rows + [(69, run)] + more, "doc_id long, text string")
    found = got(substring.deduplicate(docs, spaced=True))
    assert found == brute(rows + [(69, run)] + more, spaced=True)
    by = {x[0]: x[3] for x in found}
    assert [by[i] for i in (70, 71, 72, 73)] == ["next\tline ", "first\r\n  line", " a\x0b é\x85b", ""]


def test_empty(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in substring.op9_substring(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert found == sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows))
    assert sum(r[2] for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(substring.ORACLE_SQL["op9_substring"]).fetchall()) == found


def test_words_of_equal_hash(spark):
    """The parity sequence and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    words = substring.Words([f"{a} {b}"])
    assert words.hashes()[0] == words.hashes()[1]
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared} {a}")]
    assert got(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert [r[2] for r in brute(rows)] == [0, 0, 20]


def test_segments(monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "bb", "c" * 50]) for _ in range(n)) for n in (500, 3, 0, 70)]
    whole = substring.Words(texts)
    want, hashes = whole.places(20, 6), whole.hashes()
    monkeypatch.setattr(substring, "SEGMENT", 37)
    assert (hashes == substring.Words(texts).hashes()).all()
    assert all((x == y).all() for x, y in zip(want, substring.Words(texts).places(20, 6)))


def test_long_text(spark):
    r = random.Random(9)
    long = " ".join(r.choice(["x", "yy", "z" * 9]) for _ in range(200_000))
    rows = [(1, long), (2, "new " + long[-2000:]), (3, "w" * 2_000_000)]
    assert got(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} own {i}" if i % 3 else f"other {i} " + "short " * 5) for i in range(3000)]
    found = got(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows)


def test_index_is_kept(spark, rows, tmp_path):
    rows = sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], str(x[1])))
    parts = [rows[:10], rows[10:25], rows[25:26], rows[26:]]
    frame = lambda part: spark.createDataFrame([(*x, 5) for x in part], "doc_id long, text string, key int")
    out, before = [], []
    for part in parts:
        index = substring.Index(spark, f"file://{tmp_path}/index", max_runs=2)  # opened again for every batch
        assert len(index.runs) == min(2, index.batches)
        found = index.add(frame(part), frame(before) if before else None)
        out += got(found)
        assert found.select("rest.*").columns == ["doc_id", "text", "key"]
        index.close()
        before = before + part
    assert sorted(out, key=str) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tierlake_run")]


def test_index_reads_of_history_what_it_needs(spark, tmp_path, monkeypatch):
    """Only the texts that share something with the batch are verified, and ids that come too late are refused."""
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    old = [(i, words(f"doc{i}x"), 5) for i in range(30)]
    new = [(100, words("doc7x") + " " + words("new"), 5), (101, words("other"), 5)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string, key int")
    seen, real = [], substring._resolved
    monkeypatch.setattr(substring, "_resolved", lambda keyed, older, *a: seen.append(older) or real(keyed, older, *a))
    for few in (1 << 20, 0):
        monkeypatch.setattr(substring, "SENT_KEYS", few)
        index = substring.Index(spark, f"file://{tmp_path}/index{few}")
        index.add(frame(old)).count()
        found = index.add(frame(new), frame(old))
        assert sorted(got(found), key=str) == [r for r in brute([r[:2] for r in old + new]) if r[0] >= 100]
        assert [r.key for r in seen[-1].collect()] == [7]
        with pytest.raises(ValueError, match="come after"):
            index.add(frame([(50, "x", 5)]), frame(old + new))
        index.close(remove=True)

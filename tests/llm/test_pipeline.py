import random
import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlake.llm import language, packing

from .test_secrets import brute as secrets_of
from .test_substring import brute as passages_of


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and dict(df.dtypes) == dict(stages[0].dtypes)


def test_language_keeps_prose(stages):
    before = {r.doc_id: r.text for r in stages[0].collect()}
    after = {r.doc_id for r in stages[1].collect()}
    assert all(not any(c.isalpha() for c in before[d]) or len(before[d]) < 200 for d in set(before) - after)


def test_language_keeps_what_it_cannot_judge(spark):
    rows = [(1, None, "some words"), (2, None, "12 34"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert [tuple(r) for r in cp.identify_language(spark, df, "").collect()] == [rows[0]]


def test_language_threshold_follows_chance(spark, monkeypatch):
    model = language.Model([f"l{i:02}" for i in range(20)])
    monkeypatch.setattr(cp.language, "sample", lambda *a: [])
    monkeypatch.setattr(cp.language, "train", lambda *a: model)
    monkeypatch.setattr(cp.language, "predicted", lambda docs, model: docs.select(F.struct("*").alias("row"), F.lit("l01").alias("lang_pred"), (F.col("doc_id") / 100).alias("score")))
    df = spark.createDataFrame([(20, None, "a"), (30, None, "b"), (10, "l02", "c"), (10, "other", "d")], "doc_id long, lang string, text string")
    assert {r.text: r.lang for r in cp.identify_language(spark, df, "").collect()} == {"b": "l01", "d": "other"}


def jaccard_components(rows, width=5, least=0.8):
    sets, have = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}
        for s in sets[d]:
            have.setdefault(s, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, mine in sets.items():
        for other, n in Counter(o for s in mine for o in have[s] if o < d).items():
            if n >= least * (len(mine) + len(sets[other]) - n):
                x, y = sorted((find(d), find(other)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_near_copies_by_similarity(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == set(jaccard_components(rows).values())


def test_near_copies_of_edited_texts(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((3, 60, 400)))]
        for _ in range(5):
            rows.append((len(rows), " ".join(w if r.random() > i % 8 / 100 else "new" for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(jaccard_components(rows).values())
    assert {x.doc_id for x in cp.drop_near_copies(spark, df, "").collect()} == want < set(range(len(rows)))
    assert cp.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_different_texts_of_one_id_stay(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (4, text("c")), (4, text("d")), (4, text("d") + " more"), (5, text("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.text.split()[0]) for x in cp.drop_near_copies(spark, df, "").collect())
    assert got == [("4", "c0"), ("4", "d0"), ("None", "a0"), ("None", "b0")]


def test_passages(stages):
    want = {d: (g, t) for d, _, g, t in passages_of([(r.doc_id, r.text) for r in stages[2].collect()], spaced=True)}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        gone, text = want[r.doc_id]
        assert r.text == (text if gone else before[r.doc_id]) and r.n_chars == len(r.text)


def test_secrets(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for d, text in after.items():
        assert secrets_of(text)[1:3] == [0, 0]
        if not sum(secrets_of(before[d])[:3]) and "PRIVATE" not in before[d] and "eyJ" not in before[d] and "gh" not in before[d] and "xox" not in before[d]:
            assert text == before[d]


def test_packing(stages):
    check_pieces({r.doc_id: r.text for r in stages[4].collect()}, stages[5].collect())


def check_pieces(texts, rows):
    full = packing.codec(packing.default_path()).full
    ids = {d: np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for parts, total in [(sorted(p), len(ids[d])) for d, p in by_doc.items()] + [(sorted(p), sum(n for _, n in p)) for p in by_seq.values()]:
        at = 0
        for start, n in parts:
            assert start == at and n > 0
            at += n
        assert at == total
    sizes = [sum(n for _, n in p) for p in by_seq.values()]
    assert all(s <= 4096 and s & (s - 1) == 0 for s in sizes)


#: Names that the stages and their operators use inside, and other rows that they must take as they are.
CLASHES = ["row", "rest", "new_text", "secret_spans", "score", "lang_pred", "key", "spread", "r1", "r2", "component", "kept", "n_removed", "n_words", "k", "hot", "g"]


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_clashing_columns(spark, name, stage):
    """Columns of any name come out as they went in, and what the stage decides does not depend on them."""
    words = " ".join(f"word{i}" for i in range(60))
    texts = [words, words, "password=abcdefghij " + words[::-1], "Some other words, quite different ones, are here.", None, "", "x" * 30_000]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    want = sorted(stage(spark, plain, "").collect(), key=str)
    out = stage(spark, wide, "")
    assert out.columns == wide.columns
    got = out.collect()
    assert sorted((r[:5] for r in got), key=str) == [tuple(r) for r in want] and want
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES)


def test_packing_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 9), (2, None, "y", 9)], "doc_id long, text string, tokens string, sequence_id long")
    assert {r.doc_id for r in cp.pack_sequences(spark, docs, "").collect()} == {1, 2}


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_tables(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, "")
    assert out.count() == 0 and (out.columns == docs.columns or name == "packing")


def chains():
    """Groups of near copies that are joined to each other by single pairs just above the bound."""
    r = random.Random(8)
    rows = []
    for shape in range(12):
        words = [f"c{shape}w{i}" for i in range(120)]
        at = 0
        for step in range(4):  # each group moves on by as much as one pair may
            for _ in range(3 if step % 2 else 8):
                rows.append((len(rows), " ".join(words + [f"e{r.randrange(10**6)}"] * (_ > 0))))
            words = words[:at] + [f"s{shape}{step}{i}" for i in range(9)] + words[at + 9 :]
            at += 9
    return rows


def test_near_copies_in_chains(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in cp.drop_near_copies(spark, df, "").collect()} == set(jaccard_components(rows).values())

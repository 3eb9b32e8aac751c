import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tierlake.llm import copies, digest, graph, simhash


def components(rows, width=3, radius=3):
    fp = {d: simhash.fingerprint(t or "", width) for d, t in rows}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def plain_fingerprint(text, width=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = components(rows)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, sf).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    for d, t in rows:
        assert got[d].fingerprint == f"{plain_fingerprint(t):016x}"


@pytest.mark.parametrize("tile", [4, 1024])
def test_links(spark, tile):
    r = random.Random(5)
    centers = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = set(centers)
    for c in centers:
        for _ in range(60):
            x = c
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df, 3, tile)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)), key=signed)
                root[y] = x
    assert {signed(x): got.get(signed(x), signed(x)) for x in fps} == {signed(x): signed(find(x)) for x in fps}


def test_simhash_edges(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (5, "a b"), (5, "a b"), (6, "A  B"), (None, "c d e f"), (None, "c d e f"), (9, "c d e f"), (7, "é " * 30000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, fp string, rep int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (5, 5), (5, 5), (6, 5), (None, 9), (None, 9), (9, 9), (7, 7)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (300, 301), (301, 300)], "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def brute_entropies(data, window):
    out = []
    for i in range(len(data) - window + 1):
        w = data[i : i + window]
        c = np.array([w.count(x) for x in set(w)], float)
        out.append(1000 - int((c * np.log2(c)).sum() * 1000 / (np.log2(window) * window)))
    return np.array(out, int)


def near(a, b, slack=1):
    return len(a) == len(b) and (not len(a) or np.abs(a.astype(int) - b).max() <= slack)


def test_digest_features():
    texts = [("The quick brown fox jumps over 13 lazy dogs; ünïcode too. " * 3 + "a" * 80 + "xyz" * 20), "short text of some more words", "abc", ""]
    for text in texts:
        for window in (4, 11, 16):
            assert near(digest.entropies(np.frombuffer(text.encode(), np.uint8), window, segment=50), brute_entropies(text.encode(), window))
    counts = digest.tally(texts)
    assert counts.sum() == sum(max(0, len(t.encode()) - 7) for t in texts)
    rare = digest.rarity(counts)
    used = [e for e in range(digest.STEPS) if e >= digest.LEAST]
    assert sorted(used, key=lambda e: rare[e]) == sorted(used, key=lambda e: (counts[e], e)) and (rare[: digest.LEAST] == digest._NEVER).all()
    for text in [*texts, "thirteen byte", "just nineteen bytes"]:
        data = np.frombuffer(text.encode(), np.uint8)
        rank = rare[digest.entropies(data, 8)] if len(data) >= 8 else np.empty(0, np.int16)
        run = min(16, len(rank))
        points = np.zeros(len(rank), int)
        for i in range(len(rank) - run + 1 if len(rank) else 0):
            points[min(range(i, i + run), key=lambda j: (rank[j], j))] += 1
        assert digest.select(rank, segment=37).tolist() == [i for i in range(len(rank)) if points[i] >= min(4, len(rank) - run + 1) and rank[i] < digest._NEVER]


@pytest.mark.parametrize("length", [60, 100, 119, 120, 127, 128, 135])
def test_a_text_is_like_the_text_that_it_begins(spark, length):
    """Texts of all lengths are cut alike."""
    whole = "".join(chr(97 + (i * i + 7 * i) % 23) if i % 6 else " " for i in range(139))
    df = spark.createDataFrame([(1, whole[:length]), (2, whole)], "doc_id long, text string")
    assert digest.digest_documents(df).where("doc_id = 1").first().near_next > 0.95


def test_a_kept_table_of_ranks(spark):
    """Digests of two calls with one table are those of one call with it."""
    df = spark.createDataFrame([(i, f"text {i} of a few words, and {i * i} more " * 3) for i in range(40)], "doc_id long, text string")
    rare = digest.rarity(digest.measured(df))
    of = lambda d: {r.doc_id: r.fingerprint for r in digest.digest_documents(d, rare=rare).collect()}
    assert of(df) == of(df.where("doc_id < 9")) | of(df.where("doc_id >= 9")) == {r.doc_id: r.fingerprint for r in digest.digest_documents(df).collect()}


def test_digest_of_short_texts():
    """A short text has features too: half of it in common is seen, nothing in common is not."""
    texts = ["gentle rivers bend around the old mill", "forty quick zebras jump over wax piles"]
    rare = digest.rarity(digest.tally(texts))
    a, b, c = digest.digests([texts[0], digest.edited(texts[0], texts[1]), texts[1]], rare)
    assert 0.2 < digest.likeness(a, b) < 0.8 and digest.likeness(a, c) < 0.05


def test_ranks_count_all_documents(spark):
    texts = ["one two three " * 20, None, "", "abcdefg", "é" * 500, "one two three " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert (digest.measured(df) == digest.tally([t or "" for t in texts])).all()
    assert digest.measured(df.limit(0)).sum() == 0


def test_digest_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in digest.op1_digest(spark, sf).collect()}
    assert len(got) == len(rows)
    same, rare = {}, digest.rarity(digest.tally([t or "" for _, t in rows]))
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = digest.edited(t, n)
        a, b, c = digest.digests([t, e, n], rare)
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (a.text(), b.text())
        assert abs(got[d].near_edited - digest.likeness(a, b)) < 1e-9 and abs(got[d].near_next - digest.likeness(a, c)) < 1e-9
        assert same.setdefault(t, a.text()) == a.text()
    near, far = np.array([r.near_edited for r in got.values()]), np.array([r.near_next for r in got.values()])
    assert (near[:, None] > far[None]).mean() > 0.98


def test_digest_edges(spark):
    rows = [(None, "n"), (1, None), (2, ""), (3, "x" * 9000), (4, "short"), (4, "short"), (6, "é😀" * 40000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, bucket string, key int")
    got = digest.digest_documents(df).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].near_next == 1.0 and by[2].near_next == 0.0 and by[2].fingerprint == "0:"
    one = digest.digest_documents(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_edited == one[0].near_next == 1.0
    assert digest.digest_documents(df.limit(0)).count() == 0


def test_digest_ids_and_cuts(spark):
    """Ids of other number types stay as they are; every row is followed by the next id's, whatever the number of ranges."""
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(0, 900, 3)]
    for kind in ("int", "short", "decimal(20,0)"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = digest.digest_documents(df, buckets_per_partition=20)
        assert dict(got.dtypes)["doc_id"] == df.dtypes[0][1].replace("short", "smallint")
        by = {int(r.doc_id): r.edited_sha256 for r in got.collect()}
        assert by == {d: hashlib.sha256(digest.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest() for i, (d, t) in enumerate(rows)}


def test_tiles_skip_by_population_count(monkeypatch):
    r = np.random.default_rng(6)
    fp = r.integers(0, 1 << 64, 700, np.uint64)
    fp = np.concatenate((fp, fp[:200] ^ np.uint64(5), fp[:50] ^ np.uint64(9 << 40)))
    pop = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    fp, pop = fp[order], pop[order]
    rest, to = simhash.tile_links(fp, pop, 3)
    linked = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    label = simhash._labels(linked)
    assert (rest == np.flatnonzero(label != np.arange(len(fp)))).all() and (to == label[rest]).all() and len(rest) >= 250


def test_proposals_grow_with_a_group_not_with_its_parts(spark, monkeypatch):
    """Near copies that fill many tiles propose as many links each as those that fill few, and are one component."""
    plain, made = copies.arrow_map, {}

    def counted(df, run, schema):
        n = made.setdefault(run.__qualname__.partition(".")[0], [])
        n.append(spark.sparkContext.accumulator(0))
        to = n[-1]

        def each(batches):
            for batch in run(batches):
                to.add(batch.num_rows)
                yield batch

        return plain(df, each, schema)

    monkeypatch.setattr(copies, "arrow_map", counted)
    monkeypatch.setattr(copies, "TILE", 16)
    monkeypatch.setattr(copies, "LARGE", 16, raising=False)
    base, each = [f"w{i * i % 997}" for i in range(200)], []
    for n in (40, 160):
        made.clear()
        texts = [" ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) for i in range(n)] + [" ".join(f"x{i}y{k}" for i in range(50)) for k in range(5)]
        df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "r1 long, r2 long, text string")
        got = {r.r1: r.component for r in copies.copies(df).collect()}
        assert len({got[i] for i in range(n)}) == 1 and len(set(got.values())) == 6
        each.append(sum(a.value for name in ("_proposed", "_crossing") for a in made.get(name, [])) / n)
    assert each[1] < 1.5 * each[0], each


def test_largest_label_of_an_item():
    item, label = np.array([1, 1, 1, 2, 2, 5, 5, 5, 5]), np.array([7, 8, 7, 7, 8, 3, 4, 4, 3])
    assert copies.in_largest(item, label).tolist() == [True, False, True, False, False, True, False, False, True]

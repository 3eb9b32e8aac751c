import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tierlake.llm import interpolated as lm

END = object()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def brute(rows, rounds=12):
    """rows: (id, part, text)."""
    def counts(parts):
        own, both = Counter(), Counter()
        for _, p, t in rows:
            if p in parts:
                w = tokens(t)
                own.update(w)
                both.update(zip([END, *w[:-1]], w))
        return own, both

    def estimates(own, both, u, w):
        total = sum(own.values())
        return [both[u, w] / own[u] if own[u] else 0.0, own[w] / max(1, total), 1 / (len(own) + 1)]

    bucket = lambda n: n.bit_length()
    own, both = counts({lm.KEPT})
    mix = {b: [1 / 3] * 3 for b in range(lm.BUCKETS)}
    mix[0] = [0, 0.5, 0.5]
    held = [(bucket(own[u]), estimates(own, both, u, w)) for _, p, t in rows if p == lm.DELETED for ws in [tokens(t)] for u, w in zip([END, *ws[:-1]], ws)]
    seen = {b for b, _ in held}
    for _ in range(rounds):
        share = {b: [1.0, 1.0, 1.0] for b in seen}
        for b, f in held:
            m = [x * y for x, y in zip(mix[b], f)]
            for i in range(3):
                share[b][i] += m[i] / sum(m)
        for b, s in share.items():
            if b == 0:
                s[0] = 0
            mix[b] = [x / sum(s) for x in s]
    for b in range(2, lm.BUCKETS):
        if b not in seen:
            mix[b] = mix[b - 1]
    own, both = counts({lm.KEPT, lm.DELETED})
    total, distinct = sum(own.values()), len(own)
    out = []
    for i, _, t in rows:
        w = tokens(t)
        base = sum(math.log10((own[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        model = sum(math.log10(sum(x * y for x, y in zip(mix[bucket(own[u])], estimates(own, both, u, v)))) for u, v in zip([END, *w[:-1]], w))
        out.append((i, len(w), sum(own[x] > 0 for x in w), total, base, model))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


def texts(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "a", "über", "Zug", "x" * 50, "İ", "1", "é b", "n\x1fo", " "] + [f"w{i}" for i in range(200)]
    weight = 1 / np.arange(1, len(words) + 1)
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    return ["".join(w + blanks[rng.integers(7)] for w in rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())) for _ in range(n)]


@pytest.mark.parametrize("block,piece,cut", [(1 << 20, 1 << 20, 1 << 20), (100, 1 << 20, 500), (60, 7, 40)])
def test_brute_force(spark, monkeypatch, block, piece, cut):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "SLICE", cut)
    rows = [(i, i % 10 if i % 10 < 2 else 9, t) for i, t in enumerate(texts())]
    rows += [(400, 5, None), (401, 0, ""), (402, 1, " \n "), (None, 5, "the a"), (5, 5, "again"), (5, 0, "again")] + [(500 + i, 5, "hot passage of words") for i in range(60)]
    rows = [(i, {0: lm.TEST, 1: lm.DELETED}.get(p, lm.KEPT), t) for i, p, t in rows]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "doc_id long, p int, text string, block string, score double, row int").repartition(4)
    same(lm.score(df, lm.F.col("p")).collect(), brute(rows))


def test_little_to_learn_from(spark):
    kind = "doc_id long, p int, text string"
    for rows in ([(1, lm.TEST, "a b")], [(1, lm.KEPT, "a b a"), (2, lm.TEST, "a c")], [(1, lm.DELETED, "a b a"), (2, lm.TEST, None)]):
        same(lm.score(spark.createDataFrame(rows, kind), lm.F.col("p")).collect(), brute(rows))
    assert lm.score(spark.createDataFrame([], kind), lm.F.col("p")).count() == 0
    got = lm.score(spark.createDataFrame([(1, None, "a")], kind), lm.F.col("p")).collect()
    assert [r.n_known for r in got] == [0]


def test_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rest = lambda i: zlib.crc32(str(i).encode()) % 10
    rows = [(d, {0: lm.TEST, 1: lm.DELETED}.get(rest(d), lm.KEPT), t) for d, t in docs]
    got = lm.op12_interpolated(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in got} == {d: rest(d) == 0 for d, _ in docs}
    same([(r[0], *r[2:]) for r in got], brute(rows))
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) + 0.1 * sum(r.n_tokens for r in test)  # likelier than by single words


def test_expectation_maximisation_raises_the_likelihood(spark):
    rng = np.random.default_rng(1)
    rows = [(int(b), int(p), int(c), int(o), int(n)) for b, p, c, o, n in zip(rng.integers(1, 4, 200), rng.integers(0, 4, 200), rng.integers(4, 9, 200), rng.integers(0, 50, 200), rng.integers(1, 9, 200))]
    held = spark.createDataFrame(rows, "bucket int, pair long, context long, own long, n long").cache()
    a = np.array(rows)

    def likelihood(mix):
        of = mix[a[:, 0]]
        return (a[:, 4] * np.log(of[:, 0] * a[:, 1] / a[:, 2] + of[:, 1] * a[:, 3] / 1000 + of[:, 2] / 101)).sum()

    made = [likelihood(lm.weights(held, 1000, 100, r)) for r in (0, 1, 2, 4, 8)]
    assert made == sorted(made) and made[-1] > made[0]
    assert np.allclose(lm.weights(held, 1000, 100, 3).sum(1), 1)

import hashlib

import pytest
from tokenizers import Tokenizer

from tierlake.llm import bpe, packing

from .test_pipeline import check_pieces

ODD = [
    None, "", "a<|endoftext|>b <|endoftext|>", "  \n\t x  ", "日本語 😀 é ÿ", "x" * 5000, "aaaa aaab aaaba" * 50, "it's we'LL don't İstanbul ΣΑΣ",
    "\x00\x1c\x85   z", "   a   ", "é x́y ﬁ ½ ² ª", "</w> <w>", "a\n\n b\t\tc \n d", "word " * 9000,
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(ODD)], "doc_id long, text string, length int, ids string")


def library(texts):
    tk = Tokenizer.from_file(bpe.default_path())
    out = {}
    for d, t in texts.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        out[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    return out


def test_codec(spark, sf, odd):
    got = {r.doc_id: tuple(r)[1:4] for r in bpe.encode_decode(odd, bpe.default_path(), keep_ids=True).collect()}
    assert got == library(dict(enumerate(ODD)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op5_bpe_codec(spark, sf).collect()} == library(texts)
    assert bpe.encode_decode(odd.limit(0), bpe.default_path()).count() == 0


def test_packing(spark, sf, odd):
    check_pieces(dict(enumerate(ODD)), packing.pack(odd, packing.default_path(), keep_ids=True, block_tokens=3000).collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(texts, packing.op4_packing(spark, sf).collect())
    repeated = odd.where("doc_id = 4").union(odd.where("doc_id = 4")).union(odd.where("doc_id = 4").selectExpr("cast(null as long)", "text", "length", "ids"))
    assert packing.pack(repeated, packing.default_path()).count() >= 3
    assert packing.pack(odd.limit(0), packing.default_path()).count() == 0


def test_trie_equals_merging():
    codec = bpe.codec(bpe.default_path())
    words = ["the", "there", "thereof", "Ġunbelievable", "antidisestablishment", "aaaaaaaa", "zzzz"]
    for word, ids in codec.trie.encode_words(words):
        assert [codec.trie.token[i] for i in ids] == codec.trie.merge(word)


def test_step_groups(spark):
    """Groups hold equal token counts; only a task's last ones, one a tier at most, are short."""
    rows = [(i, "word " * (i * 37 % 1500 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, packing.default_path(), step_tokens=8192, block_tokens=60_000).collect()
    sizes, groups = {}, {}
    for r in got:
        sizes.setdefault((r.sequence_id, r.tier, r.step_id), 0)
        sizes[r.sequence_id, r.tier, r.step_id] += r.length
    for (_, tier, step), n in sizes.items():
        assert n == tier
        groups.setdefault(step, []).append(tier)
    assert len({s for s, _, _ in sizes}) == len(sizes)  # a sequence is in one group
    totals = [sum(g) for g in groups.values()]
    assert max(totals) == 8192 and sum(t < 8192 for t in totals) <= 4 and len(totals) > 20
    assert sum(len(set(g)) > 1 for g in groups.values()) <= 4


def test_words_with_unknown_symbols():
    coder = packing.codec(packing.default_path())
    word = "abc一" * 3 + "the"
    assert coder.trie._known(word) == [coder.trie.ids[t] for t in coder.trie.merge(word) if t in coder.trie.ids]
    long = "一" + "ab" * 200_000  # no merging of the whole, which would take the square of its length
    assert len(coder.trie._known(long)) > 1


def test_caches_are_bounded_and_dropped(spark, monkeypatch):
    coder = bpe.ByteLevelCodec(bpe.default_path())
    monkeypatch.setattr(coder, "MAX_CACHE", 50_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    want = [Tokenizer.from_file(bpe.default_path()).encode(t, add_special_tokens=False).ids for t in texts]
    got = []
    for t in texts:
        got += [[int(x) for x in ids.split(",")] for ids, _ in coder.encode_batch([t])]
        assert coder.held <= 50_000 + 60 * 3 * (2 * bpe.ENTRY + 40)
    assert got == want
    coder.forget()
    assert not coder.ids and not coder.raw and not coder.trie.fits

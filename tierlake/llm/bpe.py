"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

Greedy byte-pair merging has the prefix property: if a word's encoding ends in token t, then
what stands before t is the encoding of the word's shorter prefix. So the encoding of every
prefix is known from one state, its last token. The distinct words of a batch form a trie;
a depth-first walk gives each trie node its last token from its ancestors', so the encodings
of shared prefixes are worked out once. Sorting the words puts them in the trie's depth-first
order: the state stack is cut to the common prefix with the word before and grows from there.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, register_cache, table, text_of

#: Bytes of a cached word beside its characters and ids: two objects' heads and a place in a table.
ENTRY = 200


def without_gc(method: Callable) -> Callable:
    """Large caches of strings hold no cycles; scanning them while they grow takes long."""

    @wraps(method)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return method(*args)
        finally:
            if on:
                gc.enable()

    return run


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class TrieEncoder:
    """Encodes words given as strings of symbols.

    ``vocab`` maps symbol strings to ids and ``merges`` lists pairs in rank order.
    """

    MAX_PAIRS = 300_000

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # a token that merging does not rebuild from its own symbols never appears in an encoding
        self.ids = {t: i for t, i in vocab.items() if len(t) == 1 or self.merge(t) == [t]}
        self.token = {i: t for t, i in self.ids.items()}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()  # the tokens that end at each symbol of a word
        for t, i in self.ids.items():
            self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.fits: dict[int, bool] = {}

    def merge(self, word: str) -> list[str]:
        """Plain greedy merging, lowest rank first, leftmost on ties."""
        parts = list(word)
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their joined symbols."""
        if len(self.fits) > self.MAX_PAIRS:
            self.fits.clear()
        a, b = self.token[left], self.token[right]
        ok = self.fits[left << 20 | right] = self.merge(a + b) == [a, b]
        return ok

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word and its ids, in sorted order; symbols that no token has are left out."""
        fits, follows, size, ends = self.fits, self._follows, self.size, self.ends.iter
        before, last = "", [-1]  # last[n]: the last token of the prefix of n symbols
        for word in sorted(set(words)):
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            last[n + 1 :] = [-1] * (len(word) - n)
            for stop, (token, width) in ends(word):  # of those that end at one symbol the longest first
                stop += 1
                if stop <= n or last[stop] >= 0:
                    continue
                if stop == width:
                    last[stop] = token
                else:
                    left = last[stop - width]
                    if left >= 0:
                        ok = fits.get(left << 20 | token)
                        if ok or ok is None and follows(left, token):
                            last[stop] = token
            before = word
            ids, at = [], len(word)
            while at and last[at] >= 0:
                ids.append(last[at])
                at -= size[last[at]]
            yield word, self._known(word) if at else ids[::-1]

    def _known(self, word: str) -> list[int]:
        """The ids of a word with symbols that no token has: no merge goes over these, so the runs between them are words."""
        runs = "".join(c if c in self.ids else "\0" for c in word).split("\0")
        found = dict(self.encode_words(filter(None, runs)))
        return [i for run in runs if run for i in found[run]]


class ByteLevelCodec:
    """The tokenizers library's byte-level BPE without normalizer: same ids, same decoding."""

    #: The public pre-tokenization pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: The characters that the pattern's \\s stands for.
    SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    #: The same pattern as it reads for Latin-1 text.
    LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
    BLANKS = r"\t-\r \x85\xa0"
    LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
    #: Bytes that the cached words may take, by an estimate of what Python needs for them, in two generations: when the young
    #: one is full it becomes the old one, from which words that come again are taken over.
    MAX_CACHE = 192 << 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.table = {i: symbols[i] for i in range(256)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.trie = TrieEncoder(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(self.PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.latin = re.compile(self.LATIN)
        # no word goes beyond one of these runs
        self.runs = re.compile(rf" ?[^{self.SPACE}]+|[{self.SPACE}]+(?![^{self.SPACE}])|[{self.SPACE}]+")
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = {}, {}
        self.held = 0

    def forget(self) -> None:
        """Drop all cached words; a worker calls it when another stage begins, so that only the tables stay."""
        self.ids, self.raw, self.old, self.held = {}, {}, ({}, {}), 0
        self.trie.fits.clear()

    def pieces(self, text: str) -> list[str]:
        """Words of Latin-1 text, else runs of words."""
        try:
            text.isascii() or text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return self.runs.findall(text)

    def split(self, text: str) -> list[str]:
        """The units that are cached, special tokens among them as they are."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.pieces(part))]

    @without_gc
    def learn(self, runs: set[str]) -> None:
        """Put the runs that are not known yet in the cache, by one trie walk over their words."""
        if self.held > self.MAX_CACHE // 2:
            self.ids, self.raw, self.old, self.held = {}, {}, (self.ids, self.raw), 0
        new = runs.difference(self.ids)
        self.held += sum(map(len, new)) * 4 + len(new) * 2 * ENTRY
        again = new & self.old[0].keys()
        for mine, theirs in zip((self.ids, self.raw), self.old):
            mine.update(zip(again, map(theirs.__getitem__, again)))
        new -= again
        plain = [r for r in new if r[1:].isalpha() and r[0].isalpha() | (r[0] == " ") and r not in self.special]
        mixed = {r: [self.special[r]] if r in self.special else self.words.findall(r) for r in new.difference(plain)}
        words = {w for ws in mixed.values() for w in ws if isinstance(w, str)}
        words.update(plain)
        spelled = {w: w.replace(" ", self.table[32]) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.table) for w in words}
        found = dict(self.trie.encode_words(spelled.values()))
        ids_of, raw_of = {}, {}
        for w, symbols in spelled.items():
            own = found[symbols]
            ids_of[w] = ",".join(map(str, own))
            raw_of[w] = b"".join([self.bytes_of[i] for i in own])  # decoding goes by the ids, not by the word
        for r in plain:
            self.ids[r], self.raw[r] = ids_of[r], raw_of[r]
        for r, ws in mixed.items():
            if ws and not isinstance(ws[0], str):
                self.ids[r], self.raw[r] = str(ws[0]), self.bytes_of[ws[0]]
            else:
                self.ids[r], self.raw[r] = ",".join(filter(None, map(ids_of.get, ws))), b"".join(map(raw_of.__getitem__, ws))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Of each text the ids in decimal, joined by commas, and the text decoded from them."""
        at = 0
        while at < len(texts):  # as many texts as a bounded number of characters
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            self.learn(set().union(*split))
            for words in split:
                joined = ",".join(filter(None, map(self.ids.__getitem__, words)))
                yield joined, b"".join(map(self.raw.__getitem__, words)).decode("utf-8", "replace")
            at = end


@lru_cache(maxsize=2)
def codec(path: str) -> ByteLevelCodec:
    made = ByteLevelCodec(path)
    register_cache(made.forget)
    return made


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode its ids, and digest both.

    Returns the id column, n_tokens, ids_sha256 and decoded_sha256, with ``keep_ids`` also
    ids (array<int>) and decoded. A null text counts as empty: no tokens, digests of the empty
    string. Repeated rows are encoded each, null ids are kept, other columns are not read.
    No shuffle: each task encodes its rows; its word cache is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            n, ids, out, full, plain = [], [], [], [], []
            for joined, text in coder.encode_batch(batch.column(1).to_pylist()):
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                out.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    full.append([int(i) for i in joined.split(",")] if joined else [])
                    plain.append(text)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
            if keep_ids:
                arrays += [pa.array(full, pa.list_(pa.int32())), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).transform(arrow_map, run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_path())

"""Hierarchical packing of tokenised documents into sequences of several lengths.

Each task tokenises its documents and routes them to context tiers (powers of two up to the
longest). A document of the longest tier's length or more yields whole long sequences first.
Then the tiers are packed from the longest down: a window opens with the tier's longest piece,
its gap is filled by the longest pieces that fit, from this tier and every shorter one, and what
is still open by the head of one piece that is cut there. So every closed window is exactly full.
At the end of a task the few tokens left over go into windows of falling powers of two, which
need no padding either. Full windows are then dealt to step groups of equal token counts, tier
by tier, so that the data-parallel workers of a step do equal work; at a task's end the groups
that lack tokens take sequences of any tier, so only a task's last groups, one a tier, can be short.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ENTRY, TrieEncoder, byte_symbols, without_gc
from .common import arrow_map, register_cache, table, text_of


class WordCodec:
    """Ids of the tokenizers library for BPE with word ends over lower-cased text."""

    #: Bytes that the cached words may take, by an estimate of what Python needs for them, in two generations: when the young
    #: one is full it becomes the old one, from which words that come again are taken over.
    MAX_CACHE = 160 << 20
    END = 0x1000
    #: The public pre-tokenization pattern, as it reads for lower-case text of Latin-1.
    LETTERS = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
    LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\x20\x09-\x0D\x85\xa0{LETTERS}{NUMBERS}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        marked = lambda t: t[:-5] + chr(ord(t[-5]) + self.END) if t.endswith("</w>") and len(t) > 4 else t
        merges = [tuple(map(marked, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.trie = TrieEncoder({marked(t): i for t, i in spec["model"]["vocab"].items()}, merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = re.compile(self.LATIN)
        self.table = dict(enumerate(byte_symbols()))
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Drop all cached words; a worker calls it when another stage begins, so that only the tables stay."""
        self.ids, self.old, self.held = {}, {}, 0
        self.trie.fits.clear()

    def parts(self, text: str) -> list[str]:
        """Units whose encodings, joined, are the text's: words of Latin-1 text, else runs between blanks.

        In Latin-1 text every character is its own composed form and its lower case is in Latin-1
        too, so the words of the lower-cased text are the library's.
        """
        try:
            text.isascii() or text.encode("latin-1")
            if "<|" not in text:
                return self.words.findall(text.lower())
        except UnicodeEncodeError:
            pass
        return [" " + run for run in re.findall("[^\x20\t-\r]+", text)]

    @without_gc
    def learn(self, units: set[str]) -> None:
        if self.held > self.MAX_CACHE // 2:
            self.ids, self.old, self.held = {}, self.ids, 0
        new = units.difference(self.ids)
        self.held += sum(map(len, new)) * 2 + len(new) * ENTRY
        again = new & self.old.keys()
        self.ids.update(zip(again, map(self.old.__getitem__, again)))
        new -= again
        spelled, odd = {}, {}
        for u in new:
            if u[0] != " ":
                w = u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(self.table)
                spelled[w[:-1] + chr(ord(w[-1]) + self.END)] = u
                continue
            if any(s in u for s in self.special):  # matched before anything else, so left to the library
                self.ids[u] = array.array("I", self.full.encode(u, add_special_tokens=False).ids).tobytes()
                continue
            words = [w for w, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(u[1:]))]
            odd[u] = [w[:-1] + chr(ord(w[-1]) + self.END) for w in words if w]
        own = {w: array.array("I", ids).tobytes() for w, ids in self.trie.encode_words({*spelled, *(w for ws in odd.values() for w in ws)})}
        for w, u in spelled.items():
            self.ids[u] = own[w]
        for u, ws in odd.items():
            self.ids[u] = b"".join([own[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                size += len(texts[end])
                end += 1
            split = [self.parts(t) for t in texts[at:end]]
            self.learn(set().union(*split))
            for units in split:
                yield np.frombuffer(b"".join(map(self.ids.__getitem__, units)), np.uint32)
            at = end


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    made = WordCodec(path)
    register_cache(made.forget)
    return made


class TierPacker:
    """Packs pieces (row, start, length) of documents into full windows of the given tiers."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers)
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier, sorted: (length, row, start)
        self.tokens = 0

    def add(self, row: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Take a document; yield the longest tier's windows that it fills alone."""
        start, longest = 0, self.tiers[-1]
        while length - start >= longest:
            yield [(row, start, longest)]
            start += longest
        if length > start:
            self._put(length - start, row, start)

    def _put(self, length: int, row: int, start: int) -> None:
        bisect.insort(self.open[bisect.bisect_left(self.tiers, length)], (length, row, start))
        self.tokens += length

    def _take(self, tier: int, at: int) -> tuple[int, int, int]:
        piece = self.open[tier].pop(at)
        self.tokens -= piece[0]
        return piece

    def _fitting(self, gap: int, most: int) -> tuple[int, int, int] | None:
        """The longest open piece of at most ``gap`` tokens, from tier ``most`` or a shorter one."""
        for tier in range(min(most, bisect.bisect_left(self.tiers, gap)), -1, -1):
            at = bisect.bisect_right(self.open[tier], (gap, 1 << 62, 0))
            if at:
                return self._take(tier, at - 1)
        return None

    def _cut(self, gap: int) -> tuple[int, int, int]:
        """The first ``gap`` tokens of the shortest piece that is longer."""
        for tier, pieces in enumerate(self.open):
            at = bisect.bisect_right(pieces, (gap, 1 << 62, 0))
            if at < len(pieces):
                length, row, start = self._take(tier, at)
                self._put(length - gap, row, start + gap)
                return gap, row, start
        raise AssertionError("a window is opened only where enough tokens are left")

    def _window(self, size: int, tier: int) -> list[tuple[int, int, int]]:
        pieces, gap = [], size
        while gap:
            length, row, start = self._fitting(gap, tier) or self._cut(gap)
            pieces.append((row, start, length))
            gap -= length
        return pieces

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, from the longest tier down, while a tier has pieces and enough tokens are left."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.open[tier] and self.tokens >= self.tiers[tier]:
                yield self._window(self.tiers[tier], tier)

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, in windows of falling powers of two."""
        yield from self.windows()
        while self.tokens:
            size = 1 << (self.tokens.bit_length() - 1)
            yield self._window(min(size, self.tiers[-1]), len(self.tiers) - 1)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096),
    step_tokens: int = 32768,
    block_tokens: int = 4_000_000,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences; one row per piece.

    Returns the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and besides
    tier (the sequence's token count), step_id (its step group), with ``keep_ids`` also ids.
    A null or empty text is a document of the end id alone. Repeated rows are packed each, null
    ids are kept, other columns are not read; an empty table gives no rows.

    One pass without a shuffle: a task packs the documents that it reads, holding at most about
    ``block_tokens`` tokens (a longer document counts whole). Sequence ids join the task's number
    and a counter, so a task that runs again after a loss gives the same rows.
    """
    assert all(t & (t - 1) == 0 for t in tiers), "tiers are powers of two"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = codec(path), TierPacker(tiers)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple[object, np.ndarray]] = {}
        state = {"row": 0, "sequence": 0, "step": 0}
        groups: dict[int, list[int]] = {}  # size of sequence: step group, tokens that it still takes

        def step_of(size: int, last: bool) -> int:
            """The group of a sequence: its tier's own; at the end one that lacks tokens, whatever its tier."""
            group = groups.setdefault(size, [0, 0])
            if last and group[1] < size:
                group = max(groups.values(), key=lambda g: g[1])
            if group[1] < size:
                group = groups[size]
                group[:] = state["step"], max(step_tokens, size)
                state["step"] += 1
            group[1] -= size
            return group[0]

        def emit(windows: list[list[tuple[int, int, int]]], last: bool = False) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for pieces in windows:
                size = sum(n for _, _, n in pieces)
                step = step_of(size, last)
                offset = 0
                for row, start, n in pieces:
                    doc, ids = held[row]
                    part = ids[start : start + n]
                    values = (doc, start, n, zlib.crc32(part.tobytes()), len(ids), base + state["sequence"], offset, size, base + step, *([part] if keep_ids else []))
                    for col, v in zip(cols, values, strict=True):
                        col.append(v)
                    offset += n
                state["sequence"] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        types: list[pa.DataType] = []
        full: list[list[tuple[int, int, int]]] = []
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * (len(names) - 1 - keep_ids), *([pa.list_(pa.int64())] if keep_ids else [])]
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode_batch(batch.column(1).to_pylist())):
                row = state["row"]
                state["row"] += 1
                held[row] = doc, np.append(ids, np.uint32(end_id)).astype("<u4")
                full += packer.add(row, len(held[row][1]))
                if packer.tokens + len(full) * tiers[-1] > block_tokens:  # those of full are whole long windows
                    full += packer.windows()
                    yield emit(full)
                    full = []
                    live = {p[1] for pieces in packer.open for p in pieces}
                    held = {r: held[r] for r in live}
        full += packer.rest()
        if full:
            # falling sizes, so that open groups of longer tiers are filled first
            yield emit(sorted(full, key=lambda w: -sum(n for _, _, n in w)), True)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id", *(["ids"] if keep_ids else [])]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in names[1:9]) + ", ids array<long>" * keep_ids
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).transform(arrow_map, run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())

"""Language-model scores by deleted interpolation.

The probability of a token after its context is a mixture of three maximum-likelihood estimates:
of the pair (context, token), of the token, and of any token alike. The mixture's weights depend on
how frequent the context is: contexts fall into buckets by powers of two of their count. Weights are
learned by expectation-maximisation on held-out counts: a part of the training documents is kept
back ("deleted") from the counts, and the other part's estimates are mixed so that the held-out tokens
become most likely. Documents are then scored with the counts of both parts.

Documents are coded in blocks of bounded size, each of one part of the data: its distinct words, and
the words' numbers in the order of the texts; a long text may be cut into several blocks. A block sends its
distinct tokens and pairs, as fingerprints with counts, to slices of the fingerprints' range; a slice adds
up the counts of all blocks and answers each of them. So a token or pair has at most one
entry per block, however frequent it is, texts are read once, and nothing grows on the driver: the
model's counts are never gathered in one place. Tokens are told apart by 96 bits, pairs by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, dropped, id_remainder, saved, table, text_of

#: Tokens of a block, of a piece of a long text, and entries of a slice that are aimed at.
BLOCK, PIECE, SLICE = 1 << 20, 1 << 20, 1 << 20
#: What a block's documents are for.
KEPT, DELETED, TEST = 0, 1, 2
#: Context counts up to 2 ** (BUCKETS - 1) have buckets of their own; bucket 0: the context was never seen.
BUCKETS = 48
END = b"\n"  # no word holds a blank, so no word is END; it also stands before the first word


def packed(a: np.ndarray) -> bytes:
    """An array of integers, byte by byte place and compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Coder:
    """Gathers the pieces of one block: number 0 is END, each piece has the number of the token before it, its tokens, and its row."""

    def __init__(self, part: int):
        self.part, self.numbers, self.codes = part, _Numbers({END: 0}), []
        self.rows: list[tuple[int, object, int]] = []  # row, id, tokens
        self.before: list[int] = []
        self.tokens = 0

    def add(self, row: int, doc_id: object, before: bytes, words: list[bytes], last: bool) -> None:
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.before.append(self.numbers[before])
        self.codes += [codes, np.zeros(int(last), np.int32)]
        self.rows.append((row, doc_id, len(words) + last))
        self.tokens += len(words) + last

    def row(self, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.numbers)), ">u8").reshape(-1, 2).astype(np.uint64)
        high, low = digests[:, 0], (digests[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        sizes = np.array([n for _, _, n in self.rows], np.int32)
        ids = pa.array([i for _, i, _ in self.rows], id_type)
        columns = [
            pa.array([block], pa.int64()), pa.array([self.part], pa.int32()), pa.array([len(high) + len(codes)], pa.int64()),
            pa.array([packed(high)], pa.binary()), pa.array([packed(low)], pa.binary()), pa.array([packed(codes)], pa.binary()),
            pa.array([packed(np.array(self.before, np.int32))], pa.binary()), pa.array([packed(sizes)], pa.binary()),
            pa.array([[r for r, _, _ in self.rows]], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(ids)], ids),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*_BLOCK, "ids"])


_BLOCK = ["block", "part", "entries", "high", "low", "codes", "before", "sizes", "rows"]
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _pairs(high: np.ndarray, codes: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of every token the fingerprint of (token before it, token)."""
    with np.errstate(over="ignore"):
        x = high[_contexts(codes, before, sizes)] * _MIX[0] + high[codes]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def _contexts(codes: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    starts = np.cumsum(sizes) - sizes
    out[starts] = before  # every piece has a token: END or its words
    return out


def encode(docs: DataFrame, part: Column, id_col: str, text_col: str) -> DataFrame:
    """The blocks of ``docs``, as a map over its tasks."""
    rows = docs.select(F.col(id_col).alias("id"), part.cast("int").alias("part"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        coders = {p: Coder(p) for p in (KEPT, DELETED, TEST)}
        blocks = seen = 0
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                doc_id, p = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                # lower() and split() of bytes know ASCII alone: A-Z, and the blanks space, \t, \n, \v, \f, \r
                words = batch.column(2)[i].as_py().lower().split()
                before = END
                for at in range(0, len(words) + 1, PIECE):
                    part_words = words[at : at + PIECE]
                    coders[p].add(task + seen, doc_id, before, part_words, at + PIECE > len(words))
                    before = part_words[-1] if part_words else END
                    if coders[p].tokens >= BLOCK:
                        yield coders[p].row(task + blocks, id_type)
                        blocks += 1
                        coders[p] = Coder(p)
                seen += 1
        for c in coders.values():
            if c.rows:
                yield c.row(task + blocks, id_type)
                blocks += 1

    kind = T.StructType().add("block", "long").add("part", "integer").add("entries", "long")
    for name in ("high", "low", "codes", "before", "sizes"):
        kind = kind.add(name, "binary")
    return arrow_map(rows, run, kind.add("rows", T.ArrayType(T.LongType())).add("ids", T.ArrayType(rows.schema["id"].dataType)))


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its tokens in the order of their fingerprints (order, high, low), its codes, contexts, pairs."""
    high, low, codes = unpacked(row["high"], np.uint64), unpacked(row["low"], np.uint32), unpacked(row["codes"], np.int32)
    before, sizes = unpacked(row["before"], np.int32), unpacked(row["sizes"], np.int32)
    order = np.lexsort((low, high))
    return order, high, low, codes, _contexts(codes, before, sizes), _pairs(high, codes, before, sizes), sizes


def _slices(keys: np.ndarray, slices: int) -> dict[int, slice]:
    """Of sorted fingerprints the places of each slice of their range that has some."""
    of = keys // np.uint64((1 << 64) // slices + 1) if slices > 1 else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1)))
    return {int(of[a]): slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])}


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def requests(blocks: DataFrame, slices: int) -> DataFrame:
    """(slice, block, part, and for each slice the block's fingerprints in it with their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                order, high, low, codes, _, pairs, _ = _entries(row)
                counts = np.bincount(codes, minlength=len(high))[order].astype(np.uint32)
                high, low = high[order], low[order]
                pairs, many = np.unique(pairs, return_counts=True)
                a, b = _slices(high, slices), _slices(pairs, slices)
                found = sorted(a.keys() | b.keys())
                out = {"slice": found, "block": [row["block"]] * len(found), "part": [row["part"]] * len(found), "words": [], "low": [], "n": [], "pairs": [], "m": []}
                for s in found:
                    w, p = a.get(s, slice(0)), b.get(s, slice(0))
                    out["words"].append(packed(np.diff(high[w], prepend=np.uint64(0))))
                    out["low"].append(packed(low[w]))
                    out["n"].append(packed(counts[w]))
                    out["pairs"].append(packed(np.diff(pairs[p], prepend=np.uint64(0))))
                    out["m"].append(packed(many[p].astype(np.uint32)))
                kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    kind = "slice int, block long, part int, words binary, low binary, n binary, pairs binary, m binary"
    return arrow_map(blocks.select(*_BLOCK), run, kind)


def _added(same: np.ndarray, count: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept and all training counts of each entry's key; ``same``: the key's number."""
    n = int(same.max(initial=-1)) + 1
    kept = np.bincount(same, np.where(part == KEPT, count, 0), n).astype(np.int64)
    return kept, kept + np.bincount(same, np.where(part == DELETED, count, 0), n).astype(np.int64)


def _answer(rows: list[dict]) -> Iterator[dict]:
    """Of one slice: every block's entries with the counts of their keys, and the number of training tokens, distinct and all."""
    read = lambda name, kind: [unpacked(r[name], kind) for r in rows]
    words = [np.cumsum(x, dtype=np.uint64) for x in read("words", np.uint64)]
    pairs = [np.cumsum(x, dtype=np.uint64) for x in read("pairs", np.uint64)]
    lows, n, m = read("low", np.uint32), read("n", np.uint32), read("m", np.uint32)
    part = np.array([r["part"] for r in rows])
    sizes_w, sizes_p = [len(x) for x in words], [len(x) for x in pairs]
    high, low = np.concatenate(words), np.concatenate(lows)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    same = np.empty(len(high), np.int64)
    same[order] = np.cumsum(new) - 1
    kept_w, all_w = _added(same, np.concatenate(n), np.repeat(part, sizes_w))
    same_p = np.unique(np.concatenate(pairs), return_inverse=True)[1]
    kept_p, all_p = _added(same_p, np.concatenate(m), np.repeat(part, sizes_p))
    small = lambda a: a.astype(np.uint32) if int(a.max(initial=0)) < 1 << 32 else a.astype(np.uint64)
    at_w = at_p = 0
    for r, x, y in zip(rows, sizes_w, sizes_p):
        w, p = same[at_w : at_w + x], same_p[at_p : at_p + y]
        at_w, at_p = at_w + x, at_p + y
        held = r["part"] == DELETED  # only these are used to learn the weights
        parts = [small(all_w[w]), small(all_p[p]), small(kept_w[w]) if held else None, small(kept_p[p]) if held else None]
        packs = [None if a is None else bytes([a.itemsize]) + packed(a) for a in parts]
        yield {"slice": r["slice"], "block": r["block"]} | dict(zip(("words", "pairs", "kept_words", "kept_pairs"), packs)) | {"distinct": 0, "total": 0, "kept_distinct": 0, "kept_total": 0}
    figures = {"distinct": int((all_w > 0).sum()), "total": int(all_w.sum()), "kept_distinct": int((kept_w > 0).sum()), "kept_total": int(kept_w.sum())}
    yield {"slice": rows[0]["slice"], "block": -1, "words": None, "pairs": None, "kept_words": None, "kept_pairs": None} | figures


_ANSWER = "slice int, block long, words binary, pairs binary, kept_words binary, kept_pairs binary, distinct long, total long, kept_distinct long, kept_total long"


def answers(asked: DataFrame) -> DataFrame:
    """The slices' answers: a slice's entries are bounded by the number of slices, a key's by that of the blocks."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.to_dict("records")
        return pd.DataFrame(list(_answer(rows)), columns=[c.split()[0] for c in _ANSWER.split(", ")])

    return asked.groupBy("slice").applyInPandas(run, _ANSWER)


def _counts(packs: list[bytes]) -> np.ndarray:
    """A block's answers of all slices in their order, which is that of its sorted keys."""
    return np.concatenate([unpacked(p[1:], np.uint32 if p[0] == 4 else np.uint64).astype(np.int64) for p in packs]) if packs else np.zeros(0, np.int64)


def _met(blocks: DataFrame, answered: DataFrame, kept: bool) -> DataFrame:
    """Blocks with the answers to their requests."""
    w, p = ("kept_words", "kept_pairs") if kept else ("words", "pairs")
    got = answered.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", F.col(w).alias("w"), F.col(p).alias("p")))).alias("got"))
    return blocks.join(got.select("block", F.col("got.w").alias("w"), F.col("got.p").alias("p")), "block")


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for no count, else 1 + the power of two."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _looked_up(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a block: count of its pair, of its context, its own; and the sizes of the pieces."""
    order, high, _, codes, contexts, pairs, sizes = _entries(row)
    own = np.empty(len(high), np.int64)
    own[order] = _counts(row["w"])
    both = _counts(row["p"])[np.unique(pairs, return_inverse=True)[1]]
    return both, own[contexts], own[codes], sizes


def held_out(blocks: DataFrame, answered: DataFrame) -> DataFrame:
    """(bucket, pair, context, own, n): the deleted part's tokens by the kept part's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                both, context, own, _ = _looked_up(row)
                rows, n = np.unique(np.stack([both, context, own], 1), axis=0, return_counts=True)
                columns = [_bucket(rows[:, 1]).astype(np.int32), rows[:, 0], rows[:, 1], rows[:, 2], n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["bucket", "pair", "context", "own", "n"])

    found = arrow_map(_met(blocks.where(F.col("part") == DELETED), answered, True), run, "bucket int, pair long, context long, own long, n long")
    return found.groupBy("bucket", "pair", "context", "own").agg(F.sum("n").alias("n"))


def weights(held: DataFrame, total: int, distinct: int, rounds: int = 12) -> np.ndarray:
    """[BUCKETS, 3]: weights of the pair's, the token's and the even estimate, by expectation-maximisation.

    One count is added to each weight's expectation, so that none becomes 0; a context never seen has
    no estimate of pairs, and a bucket without held-out tokens takes the weights of the next lower one.
    """
    at = np.full((BUCKETS, 3), 1 / 3)
    at[0] = 0, 0.5, 0.5
    estimates = [F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0), F.col("own") / F.lit(float(max(1, total))), F.lit(1.0 / (distinct + 1))]
    seen = np.zeros(BUCKETS, bool)
    for _ in range(rounds):
        mixed = [F.array(*map(F.lit, at[:, i].tolist()))[F.col("bucket")] * f for i, f in enumerate(estimates)]
        share = [F.sum(F.col("n") * m / (mixed[0] + mixed[1] + mixed[2])).alias(f"s{i}") for i, m in enumerate(mixed)]
        for r in held.groupBy("bucket").agg(*share).collect():  # a row for each bucket
            s = np.array([r["s0"], r["s1"], r["s2"]]) + 1
            if r["bucket"] == 0:
                s[0] = 0
            at[r["bucket"]], seen[r["bucket"]] = s / s.sum(), True
    for b in range(2, BUCKETS):
        if not seen[b]:
            at[b] = at[b - 1]
    return at


def probabilities(both: np.ndarray, context: np.ndarray, own: np.ndarray, total: int, distinct: int, mix: np.ndarray) -> np.ndarray:
    of = mix[_bucket(context)]
    pair = np.divide(both, context, out=np.zeros(len(both)), where=context > 0)
    return of[:, 0] * pair + of[:, 1] * own / max(1, total) + of[:, 2] / (distinct + 1)


def score(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    ``part`` tells KEPT and DELETED rows, which are learned from, from TEST rows; a null part counts as TEST.
    Texts are lower-cased (A-Z) and split at ASCII blanks; every text ends with one end token, which also
    is the context of the first word, so a null or empty text has one token. ``base_score`` is the
    sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, with c of all training rows; ``score`` the
    sum of log10 of the mixture. Tokens with c > 0 are known. Without training rows all estimates but the
    even one are 0. Rows of one id and equal rows count each for itself; other columns are not read; an
    empty table gives no rows.
    """
    blocks = saved(encode(docs, F.coalesce(part, F.lit(TEST)), id_col, text_col), "lm-blocks")
    entries = blocks.agg(F.sum("entries")).first()[0] or 0
    slices = max(1, -(-entries // SLICE))
    answered = saved(answers(requests(blocks, slices).repartition(slices, "slice")), "lm-answers")
    figures = answered.where("block < 0").agg(*[F.sum(c).alias(c) for c in ("distinct", "total", "kept_distinct", "kept_total")]).first()
    distinct, total, kept_distinct, kept_total = (x or 0 for x in figures)
    held = saved(held_out(blocks, answered), "lm-held-out")
    mix = weights(held, kept_total, kept_distinct, rounds)
    dropped(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_dicts(batch)):
                both, context, own, sizes = _looked_up(row)
                base = np.log10((own + 0.1) / (total + 0.1 * (distinct + 1)))
                with np.errstate(divide="ignore"):
                    model = np.log10(probabilities(both, context, own, total, distinct, mix))
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, starts)
                ids = batch.column("ids")[i].values
                columns = [pa.array(row["rows"], pa.int64()), ids, pa.array(sizes.astype(np.int64)), pa.array(add((own > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(model))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_tokens", "n_known", "base_score", "score"])

    kind = T.StructType().add("row", "long").add("id", docs.schema[id_col].dataType)
    for name, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        kind = kind.add(name, t)
    pieces = arrow_map(_met(blocks, answered, False), run, kind)
    added = pieces.groupBy("row").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return added.select("id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op12_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the ids are learned from, of these one ninth held out for the weights; a null id has remainder 0."""
    rest = id_remainder("doc_id", 10)
    part = F.when(rest == 0, TEST).when(rest == 1, DELETED).otherwise(KEPT)
    found = score(table(spark, sf_dir, "documents"), part)
    return found.select(F.col("id").alias("doc_id"), (id_remainder("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by bit overlap.

Every window of 8 bytes of a text has an entropy. How rare an entropy is, is measured: its count over
the windows of all documents makes the table of ranks, the rarest entropy first. In every run of 16
neighbouring windows the rarest one (leftmost of equals) scores a point, and windows with four points
are the text's features. Windows of nearly constant bytes never are. Windows and runs are the
same for texts of every length, so that a text shares its features with the text that it begins; one
with fewer than four runs asks for as many points as it has runs, one of fewer than 16 windows is a
single run. A text without a feature is one itself. A table of ranks can be kept: digests made with
the same table are comparable, whichever call made them.
Features enter Bloom filters of 2048 bits, five bits each, at most 160 features to a filter, then
the next filter of the chain begins. Two digests are compared filter by filter: bits in common
beyond those that chance explains, over the most that could be in common.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, partitions, table, text_of

WINDOW, RUN, POINTS, PER_FILTER, BITS, HASHES = 8, 16, 4, 160, 2048, 5
#: Entropies are thousandths of the largest, STEPS values in all; LEAST is the least that a feature may have.
STEPS, LEAST = 1001, 100
SLACK = 0.1
_NEVER = 1 << 14
#: Ranges of ids, whose cuts and heads the driver holds; each is sorted by one task, on disk where memory ends.
MOST_BUCKETS = 16384

#: _GAIN[c]: by how much the sum of c log2 c over a window's byte counts grows as a count reaches c; in 2**-20.
_F = np.array([0.0, *(c * np.log2(c) for c in range(1, 17))])
_GAIN = np.concatenate(([0], np.rint(np.diff(_F) * (1 << 20)).astype(np.int64)))


class Digest(NamedTuple):
    features: int
    filters: np.ndarray  # (chain, 256) bytes
    sizes: np.ndarray  # features of each filter

    def text(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"


def entropies(data: np.ndarray, window: int, segment: int = 65536) -> np.ndarray:
    """The entropy of the window at each start, in thousandths of the largest."""
    n = len(data) - window + 1
    out = np.empty(max(0, n), np.int16)
    for at in range(0, n, segment):
        b = data[at : at + segment + window - 1]
        m = len(b)
        ahead, behind, same = np.ones(m, np.uint8), np.ones(m, np.uint8), np.empty(m, bool)
        for d in range(1, window):
            np.equal(b[d:], b[:-d], out=same[: m - d])
            s = same[: m - d].view(np.uint8)
            ahead[: m - d] += s
            behind[d:] += s
        total = np.empty(m - window + 1, np.int64)
        total[0] = _GAIN[behind[:window]].sum()
        np.cumsum(_GAIN[behind[window:]] - _GAIN[ahead[: m - window]], out=total[1:])
        total[1:] += total[0]
        out[at : at + len(total)] = 1000 - (total * 1000 / (np.log2(window) * window * (1 << 20))).astype(np.int64)
    return out


def tally(texts: list[str]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    raw = [t.encode() for t in texts]
    every, at = entropies(np.frombuffer(b"".join(raw), np.uint8), WINDOW), 0
    counts = np.zeros(STEPS, np.int64)
    for data in raw:
        counts += np.bincount(every[at : at + max(0, len(data) - WINDOW + 1)], minlength=STEPS)
        at += len(data)
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy: lower is rarer, equally rare ones by entropy; _NEVER below LEAST."""
    out = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.int16)
    out[:LEAST] = _NEVER
    return out


def _least(rank: np.ndarray, width: int) -> np.ndarray:
    """Position of the lowest rank, leftmost of equals, in each run of ``width`` neighbours."""
    n = len(rank)
    blocks = -(-n // width)
    key = np.full(blocks * width, np.iinfo(np.int64).max)
    key[:n] = rank.astype(np.int64) << 40 | np.arange(n)
    key = key.reshape(blocks, width)
    fore = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n]) & ((1 << 40) - 1)


def select(rank: np.ndarray, segment: int = 1 << 18) -> np.ndarray:
    """Starts of the features, in order, for the ranks of one text's windows."""
    if not len(rank):
        return np.empty(0, np.int64)
    width = min(RUN, len(rank))
    points = np.zeros(len(rank), np.int32)
    for at in range(0, len(rank) - width + 1, segment):
        part = rank[at : at + segment + width - 1]
        points[at : at + len(part)] += np.bincount(_least(part, width), minlength=len(part)).astype(np.int32)
    return np.flatnonzero((points >= min(POINTS, len(rank) - width + 1)) & (rank < _NEVER))


def make(hashes: list[int]) -> Digest:
    h = np.array(list(dict.fromkeys(hashes)), np.uint64)
    chain = -(-len(h) // PER_FILTER)
    bits = np.zeros((chain, BITS), bool)
    nth = np.arange(len(h)) // PER_FILTER
    for k in range(HASHES):
        bits[nth, (h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return Digest(len(h), np.packbits(bits, axis=1), np.bincount(nth, minlength=chain))


def digests(texts: list[str], rare: np.ndarray) -> list[Digest]:
    """The digest of each whole text, with a table of ranks. A text without a feature has one, all of it; an empty text has none."""
    raw = [t.encode() for t in texts]
    rank, at = rare[entropies(np.frombuffer(b"".join(raw), np.uint8), WINDOW)], 0
    out: list[Digest] = []
    for data in raw:
        found = select(rank[at : at + max(0, len(data) - WINDOW + 1)]).tolist()
        parts = [data[j : j + WINDOW] for j in found] or [data][: len(data)]
        out.append(make([xxhash.xxh64_intdigest(p) for p in parts]))
        at += len(data)
    return out


def measured(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``tally`` of all documents' whole texts; a count for each entropy is what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS, np.int64)
        for batch in batches:
            part, size = [], 0
            for text in batch.column(0).to_pylist():
                part.append(text)
                size += len(text)
                if size > 500_000:
                    counts += tally(part)
                    part, size = [], 0
            counts += tally(part)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["at", "n"])

    found = docs.select(text_of(text_col).alias("text")).transform(arrow_map, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(STEPS, np.int64)
    for r in found.collect():
        out[r["at"]] = r["n"]
    return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1. Each filter of the shorter chain counts by its features, with its best match in the other."""
    if not a.features or not b.features:
        return float(a.features == b.features)
    if (len(a.filters), a.features) > (len(b.filters), b.features):
        a, b = b, a
    ones_b = np.bitwise_count(b.filters).sum(1, dtype=np.int64)
    wide = b.filters.view(np.uint64)
    total = 0.0
    for row, size in zip(a.filters.view(np.uint64), a.sizes.tolist()):
        ones = int(np.bitwise_count(row).sum(dtype=np.int64))
        common = np.bitwise_count(row[None, :] & wide).sum(1, dtype=np.int64)
        most = np.minimum(ones, ones_b)
        chance = ones * ones_b / BITS
        floor = chance + SLACK * (most - chance)
        score = np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), common == most)
        total += size * float(np.clip(score, 0, 1).max())
    return total / int(a.sizes.sum())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbours(docs: DataFrame, id_col: str, text_col: str, buckets_per_partition: int) -> tuple[DataFrame, int]:
    """Rows (bucket, tail, key, id, text), each bucket followed by the first row of the next one.

    Buckets are ranges of the id between its quantiles; their number is bounded by the parameter,
    and so is what is gathered here: quantiles and each bucket's least id.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    count = min(MOST_BUCKETS, n * buckets_per_partition)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    cuts = keyed.agg(F.percentile_approx("key", [i / count for i in range(1, count)] or [0.5], 20000)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, math.isqrt(len(cuts)))  # how many cuts are at most the key: first in steps, then inside one
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("key")))
    if cuts:
        every = F.lit(cuts).cast("array<long>")
        keyed = keyed.withColumn("coarse", below(F.lit(cuts[step - 1 :: step]).cast("array<long>")))
        keyed = keyed.withColumn("bucket", F.col("coarse") * step + below(F.slice(every, F.col("coarse") * step + 1, F.lit(step)))).drop("coarse")
    else:
        keyed = keyed.withColumn("bucket", F.lit(0))
    heads = {r[0]: r[1] for r in keyed.groupBy("bucket").agg(F.min("key")).collect()}
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    head = F.lit([heads.get(b) for b in range(len(cuts) + 1)]).cast("array<long>")[F.col("bucket")] if heads else F.lit(None).cast("long")
    back = F.lit([before.get(b) for b in range(len(cuts) + 1)]).cast("array<int>")[F.col("bucket")] if heads else F.lit(0)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    to = F.when(F.col("key") == head, F.array(own, F.struct(back.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    rows = keyed.select(F.explode(to).alias("to"), "key", "id", "text").select("to.bucket", "to.tail", "key", "id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "key", "text"), n


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets_per_partition: int = 8, rare: np.ndarray | None = None) -> DataFrame:
    """Fingerprint every whole text, its edited text, and compare both and the next document.

    Returns the id column, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Rows follow each other by id, null ids first, rows of one id by text; after the last
    comes the first, so a single row follows itself. A null text counts as empty; an empty text has
    no features and is like another empty text (1.0) and unlike any other (0.0). Other columns are
    not read. The texts are shuffled once. ``rare`` is a kept table of ranks (``rarity(measured(...))``
    of some corpus); without one the texts are read once more, and all documents make the table.
    """
    rare = rarity(measured(docs, text_col)) if rare is None else rare
    rows, _ = _neighbours(docs, id_col, text_col, buckets_per_partition)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
        held = None  # bucket, id, text of the row that waits for the next
        for batch in batches:
            for bucket, tail, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if held and held[0] == bucket:
                    yield held[1], held[2], text
                held = None if tail else (bucket, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: list[tuple[object, str, str]]) -> pa.RecordBatch:
            changed = [edited(t, n) for _, t, n in part]
            distinct = list(dict.fromkeys([*(t for _, t, _ in part), *changed, *(n for _, _, n in part)]))
            known = dict(zip(distinct, digests(distinct, rare)))
            cols = zip(*((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), known[t].text(), known[e].text(), likeness(known[t], known[e]), likeness(known[t], known[n])) for (doc, t, n), e in zip(part, changed)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        part, size = [], 0
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for pair in pairs(batches):
            part.append(pair)
            size += len(pair[1])
            if size > 500_000:
                yield flush(part)
                part, size = [], 0
        if part:
            yield flush(part)

    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.transform(arrow_map, run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))

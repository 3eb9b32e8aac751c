r"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``length`` consecutive words. Its fingerprint is the least hash among the ``gram``-word
grams inside it (leftmost of equals), so equal windows have equal fingerprints, while neighbouring
windows mostly share theirs: a document has about one place, that is a gram with the windows of
which it is the least, for every eight words.

The index (``Index``) is a list of immutable runs, tables of (fingerprint, number of places)
bucketed and sorted by fingerprint, beside the postings (fingerprint, document) as they came.
A new batch's fingerprints are counted, written as its run, and merge-joined with every older run;
as all runs share their bucketing, nothing is shuffled for it. Fingerprints that have one place in
all of history are settled: their windows are new. When more than ``max_runs`` runs have gathered,
the two smallest are merged to one. Runs and postings stay in their folder between calls.

For the other fingerprints the words themselves are verified, by cryptographic digests (BLAKE2b, 128
bits) of their bytes. A place's windows together cover a stretch of text. Places of one fingerprint
whose stretches are all equal need no more: the earliest one stays. Otherwise the earliest place of
each different stretch has its windows digested one by one, and the earliest start of each window
stays. Nothing is gathered per window or passage, in any task: a passage in many documents is a
minimum, pre-aggregated before its shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, exists, partitions, removed, saved, shared_path, table, text_of

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1 << 20, 1 << 63, 256, np.uint64)
_BYTE[32] = 0
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of words that are hashed at a time, and windows whose fingerprints are.
SEGMENT = 1 << 20
#: Documents whose keys a broadcast takes, 8 bytes each; more are joined by a shuffle.
SENT_KEYS = 1 << 20
#: The key of a null id, before all others.
_LEAST = -(1 << 63)
#: Marks, among the other columns, a text that was null.
_NULL = "text is null"


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 10) - 1, base, np.uint64))))
        if n <= 2 * SEGMENT:
            _POWERS[base] = known
    return known[:n]


class Words:
    """The words of several texts in one row, with hashes of their grams and digests of their bytes."""

    def __init__(self, texts: list[str]):
        self.norm = [b" ".join(t.encode().split()) for t in texts]  # bytes split at ASCII blanks only
        self.count = np.fromiter((t.count(b" ") + 1 if t else 0 for t in self.norm), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # each text's first word
        self.n = int(self.first[-1])
        self.data = b" ".join(filter(None, self.norm))
        raw = np.frombuffer(self.data, np.uint8)
        self.end = np.append(np.flatnonzero(raw == 32), len(raw))[: self.n]  # of each word in data
        self.begin = np.concatenate(([0], self.end[:-1] + 1))[: self.n]

    def hashes(self) -> np.ndarray:
        """A hash of each word; different words may share one, which costs a verification."""
        out = np.empty(self.n, np.uint64)
        raw = np.frombuffer(self.data + b" ", np.uint8)
        at = 0
        while at < self.n:
            low = int(self.begin[at])
            to = max(at + 1, int(np.searchsorted(self.end, low + SEGMENT, "right")))
            part = raw[low : int(self.end[to - 1]) + 1]
            sums = _BYTE[part]
            sums *= _powers(_STEP, len(part))
            np.cumsum(sums, out=sums)
            until = sums[self.end[at:to] - low]
            h = until.copy()
            h[1:] -= until[:-1]
            out[at:to] = _mixed(h * _powers(_INVERSE, len(part))[self.begin[at:to] - low])
            at = to
        return out

    def places(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window's start, windows, fingerprint) of every place, in order.

        Of equal least hashes in a window the leftmost counts, so equal windows have theirs at equal
        offsets. Hashes are compared by 40 bits, then by place, as running minima of blocks.
        """
        if not (self.count >= length).any():
            none = np.empty(0, np.int64)
            return none, none, none.view(np.uint64)
        words, low, width = self.hashes(), np.uint64((1 << 24) - 1), length - gram + 1
        g = np.zeros(self.n - gram + 1, np.uint64)
        for j, p in enumerate(_powers(2 + 0x632BE59BD9B4E019, gram)):
            g += words[j : j + len(g)] * p
        g = _mixed(g)
        place = np.empty(self.n - length + 1, np.int64)
        for at in range(0, len(place), SEGMENT):
            part = g[at : at + SEGMENT + width - 1]
            blocks = -(-len(part) // width)
            key = np.full(blocks * width, np.iinfo(np.uint64).max)
            key[: len(part)] = part & ~low | np.arange(len(part), dtype=np.uint64)
            key = key.reshape(blocks, width)
            fore = np.minimum.accumulate(key, axis=1).ravel()
            back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
            place[at : at + SEGMENT] = (np.minimum(back[: len(part) - width + 1], fore[width - 1 : len(part)]) & low).astype(np.int64) + at
        inside = np.zeros(self.n + 1, np.int64)  # windows that go beyond their text go
        long = self.count >= length
        inside[self.first[:-1][long]] = 1
        inside[self.first[1:][long] - length + 1] -= 1
        start = np.flatnonzero(np.cumsum(inside)[: len(place)])
        place = place[start]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        return start[new], np.diff(np.append(new, len(place))), g[place[new]]

    def digests(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """(n, 2): BLAKE2b of the bytes of so many words from each start on."""
        data = self.data
        made = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.begin[start].tolist(), self.end[start + words - 1].tolist())]
        return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)

    def text(self, at: int, dropped: np.ndarray) -> bytes:
        """The words of one text that are not dropped, joined by one space."""
        first, last = int(self.first[at]), int(self.first[at + 1])
        edge = np.flatnonzero(np.diff(dropped[first:last].astype(np.int8), prepend=1, append=1)) + first
        return b" ".join([self.data[a:b] for a, b in zip(self.begin[edge[::2]].tolist(), self.end[edge[1::2] - 1].tolist())])


def _cut(text: str, dropped: np.ndarray) -> str:
    """The text without its dropped words. A run of them takes the blanks before it along, at the text's ends those on both sides."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    ink = np.diff(((raw != 32) & ((raw < 9) | (raw > 13))).view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(ink == 1), np.flatnonzero(ink == -1)
    edge = np.flatnonzero(np.diff(dropped.astype(np.int8), prepend=1, append=1))
    out: list[bytes] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # words a to b - 1 stay
        start = 0 if a == 0 else end[a - 1] if out else begin[a]
        out.append(data[start : len(data) if b == len(begin) else end[b - 1]])
    return b"".join(out).decode()


def _chunks(texts: list[str], size: int = 1_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is alone."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) < size):
            n += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def _code(owner: np.ndarray, place: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """A text's number, a start and a hash in one word."""
    return (owner.astype(np.uint64) << np.uint64(40) ^ np.asarray(place).astype(np.uint64)) * np.uint64(_STEP) ^ value.view(np.uint64)


def _flat(column: pa.ListArray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the entries of the lists in some rows; owner counts these rows, a null list has no entry."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    count = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)[rows]
    at = np.repeat(offsets[:-1][rows] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return np.repeat(np.arange(len(rows)), count), column.values.to_numpy(zero_copy_only=False)[at]


def _open(words: Words, length: int, gram: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, windows, fingerprint) of the places whose fingerprint is among their text's repeated ones."""
    start, count, value = words.places(length, gram)
    of = np.searchsorted(words.first, start, "right") - 1
    keep = np.isin(_code(of, 0, value), _code(hot[0], 0, hot[1]))
    return of[keep], start[keep], count[keep], value[keep]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every number of the ranges that begin at start and have count members."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _fingerprints(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, key), once for every place: a fingerprint that a text repeats counts as repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in _chunks(texts):
                words = Words(texts[part])
                start, _, value = words.places(length, gram)
                key = keys[part][np.searchsorted(words.first, start, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(key, pa.int64())], names=["g", "key"])

    return keyed.select("key", "text").transform(arrow_map, run, "g long, key long")


class Index:
    """Fingerprints of all documents inserted so far, in a folder that driver and executors share.

    ``folder`` may hold an index already; it is then opened with its own length, gram and buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 20, gram: int = 6, max_runs: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.max_runs = spark, folder, max_runs
        self.length, self.gram, self.buckets = length, gram, buckets or partitions(spark)
        self.batches, self.runs = 0, []  # runs: (number, rows)
        self.names: dict[int, str] = {}
        self.state = 0
        while exists(spark, f"{folder}/state/{self.state + 1}/_SUCCESS"):
            self.state += 1
        if self.state:
            row = spark.read.parquet(f"{folder}/state/{self.state}").first()
            self.length, self.gram, self.buckets, self.batches, self.runs = row.length, row.gram, row.buckets, row.batches, [tuple(r) for r in row.runs]

    def _note(self) -> None:
        row = [(self.length, self.gram, self.buckets, self.batches, self.runs)]
        df = self.spark.createDataFrame(row, "length int, gram int, buckets int, batches int, runs array<struct<number: int, rows: long>>")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/{self.state + 1}")
        self.state += 1

    def _table(self, number: int) -> DataFrame:
        if number not in self.names:
            self.names[number] = f"tierlake_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.names[number]} (g LONG, n LONG) USING parquet CLUSTERED BY (g) SORTED BY (g) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run/{number}'"
            )
        return self.spark.table(self.names[number])

    def _write(self, rows: DataFrame) -> tuple[int, int]:
        number = max([self.batches, *(n for n, _ in self.runs)]) + 1 if self.runs else self.batches + 1
        name = f"tierlake_run_{uuid.uuid4().hex}"
        rows.write.mode("overwrite").bucketBy(self.buckets, "g").sortBy("g").option("path", f"{self.folder}/run/{number}").saveAsTable(name)
        self.names[number] = name
        return number, self._table(number).count()

    def insert(self, keyed: DataFrame) -> DataFrame:
        """Add a batch (key, text) and return (g): its fingerprints that have more places than one in all of history."""
        path = f"{self.folder}/postings/{self.batches}"
        _fingerprints(keyed, self.length, self.gram).write.mode("overwrite").parquet(path)
        new = self._write(self.spark.read.schema("g long, key long").parquet(path).groupBy("g").agg(F.count(F.lit(1)).alias("n")))
        counts, often = self._table(new[0]), F.col("n") > 1
        for number, _ in self.runs:
            counts = counts.join(self._table(number).select("g", F.col("n").alias(f"n{number}")).hint("merge"), "g", "left")
            often = often | F.col(f"n{number}").isNotNull()
        repeated = saved(counts.where(often).select("g"), "repeated")
        self.batches += 1
        self.runs.append(new)
        old = self.compact() if len(self.runs) > self.max_runs else []
        self._note()
        for number in old:
            self._drop(number, True)
        return repeated

    def compact(self) -> list[int]:
        """Merge the two smallest runs to one; returns their numbers. What reads them goes on until they are dropped."""
        (a, _), (b, _) = sorted(self.runs, key=lambda r: (r[1], r[0]))[:2]
        both = self._table(a).join(self._table(b).select("g", F.col("n").alias("m")).hint("merge"), "g", "full")
        self.runs.append(self._write(both.select("g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n"))))
        self.runs = [r for r in self.runs if r[0] not in (a, b)]
        return [a, b]

    def postings(self) -> DataFrame:
        return self.spark.read.schema("g long, key long").parquet(*[f"{self.folder}/postings/{i}" for i in range(self.batches)])

    def _drop(self, number: int, files: bool) -> None:
        if number in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(number)}")
        if files:
            removed(self.spark, f"{self.folder}/run/{number}")

    def close(self, remove: bool = False) -> None:
        """Take the runs out of the session's catalog, with ``remove`` delete the whole index."""
        for number in list(self.names):
            self._drop(number, False)
        if remove:
            removed(self.spark, self.folder)

    def add(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False) -> DataFrame:
        """Insert a batch and remove from it what ``history``, all documents inserted before, or the batch itself has earlier.

        The batch's ids come after those of history, else ValueError. Returns what ``deduplicate`` does, for the batch. Of history
        only the documents that share a fingerprint with the batch, or have one that it repeats, are shuffled and verified.
        """
        keyed = _keyed(docs, id_col, text_col)
        if self.batches:
            last, first = self.postings().agg(F.max("key")).first()[0], keyed.agg(F.min("key")).first()[0]
            if last is not None and first is not None and first < last:
                raise ValueError(f"ids of a batch come after those of earlier ones: {first} is below {last}")
        repeated = self.insert(keyed)
        lists = _lists(self.postings(), repeated)
        older = None
        if history is not None:
            keys = lists.select("key")
            keys = F.broadcast(keys) if keys.count() <= SENT_KEYS else keys
            older = _keyed(history, id_col, text_col).select("key", "text").join(keys, "key", "left_semi")
        return _finished(_resolved(keyed, older, lists, self.length, self.gram, spaced), docs, id_col, text_col)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").isNull().alias(_NULL))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST)).alias("key"), text_of(F.col(f"`{text_col}`")).alias("text"), rest.alias("rest"))


def _lists(postings: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, hot): repeated fingerprints by document; a list has no more entries than its document has grams."""
    return saved(postings.join(repeated, "g", "left_semi").groupBy("key").agg(F.collect_set("g").alias("hot")), "lists")


def _resolved(keyed: DataFrame, older: DataFrame | None, lists: DataFrame, length: int, gram: int, spaced: bool) -> DataFrame:
    """``keyed`` with n_words, n_removed and kept. The texts are shuffled once, and that exchange is read three times."""
    if older is None:
        texts = keyed
    else:
        texts = keyed.unionByName(older.withColumn("rest", F.lit(None).cast(keyed.schema["rest"].dataType)))
    least, most, longest = texts.agg(F.min(F.when(F.col("key") > _LEAST, F.col("key"))), F.max("key"), F.max(F.octet_length("text"))).first()
    least = _LEAST + 1 if least is None else least
    # the reach of keys and starts decides how a start in a document is packed
    narrow = (most or 0) - least < (1 << 36) and (longest or 0) < (1 << 27)
    shift = 1 << (26 if narrow else 40)
    wide = lambda c: c if narrow else c.cast("decimal(38,0)")

    def packed(place: Column) -> Column:
        order = F.when(F.col("key") == _LEAST, wide(F.lit(0).cast("long"))).otherwise(wide(F.col("key")) - wide(F.lit(least).cast("long")) + wide(F.lit(1).cast("long")))
        return order * wide(F.lit(shift).cast("long")) + wide(place)

    def unpacked(start: Column) -> tuple[Column, Column]:
        order = F.shiftright(start, 26) if narrow else F.floor(start / F.lit(shift).cast("decimal(38,0)"))
        place = (start - order * wide(F.lit(shift).cast("long"))).cast("long")
        return F.when(order == 0, F.lit(_LEAST)).otherwise((order + wide(F.lit(least).cast("long")) - wide(F.lit(1).cast("long"))).cast("long")), place

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in _chunks(texts):
                words = Words(texts[part])
                of, start, count, value = _open(words, length, gram, _flat(batch.column(3), range(len(texts))[part]))
                d = words.digests(start, count + length - 1)
                cols = value.view(np.int64), d[:, 0], d[:, 1], keys[part][of], start - words.first[of], count
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "d1", "d2", "key", "s", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in _chunks(texts):
                words = Words(texts[part])
                (of, start), (_, count), (_, mixed) = (_flat(batch.column(i), range(len(texts))[part]) for i in (3, 4, 5))
                # of several versions of one document a shorter one may not have the place
                count = np.where(mixed, np.clip(words.count[of] - length + 1 - start, 0, count), 0)
                at = _spread(words.first[of] + start, count)
                of = np.repeat(of, count)
                d = words.digests(at, length)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (d[:, 0], d[:, 1], keys[part][of], at - words.first[of])], names=["w1", "w2", "key", "p"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone, kept = batch.column(0).to_pylist(), [], [], []
            for part in _chunks(texts):
                rows = range(len(texts))[part]
                lists = [_flat(batch.column(i), rows) for i in range(1, 7)]
                (owner, starts), (_, stretch), (_, mixed), (of_first, firsts), (_, digest) = lists[1:]
                words = Words(texts[part])
                of, start, count, _ = _open(words, length, gram, lists[0])
                code, mine = _code(of, start - words.first[of], words.digests(start, count + length - 1)[:, 0]), _code(owner, starts, stretch)
                first = np.isin(code, mine)
                split = first & np.isin(code, mine[mixed])
                at = _spread(start[split], count[split])
                whose = np.repeat(of[split], count[split])
                again = at[~np.isin(_code(whose, at - words.first[whose], words.digests(at, length)[:, 0]), _code(of_first, firsts, digest))]
                begin = np.concatenate((start[~first], again))
                end = np.concatenate((start[~first] + count[~first] + length - 1, again + length))
                edges = np.bincount(begin, minlength=words.n + 1) - np.bincount(end, minlength=words.n + 1)
                drop = np.cumsum(edges)[:-1] > 0
                n = np.diff(np.concatenate(([0], np.cumsum(drop)))[words.first])
                total += words.count.tolist()
                gone += n.tolist()
                if spaced:
                    some = zip(n.tolist(), texts[part], words.first[:-1].tolist(), words.first[1:].tolist())
                    kept += [_cut(t, drop[a:b]) if m else t for m, t, a, b in some]
                else:
                    kept += [(words.text(i, drop) if m else t).decode() for i, (m, t) in enumerate(zip(n.tolist(), words.norm))]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), batch.column(0), batch.column(7)], names=["n_words", "n_removed", "kept", "text", "rest"])

    # rest is only in every branch so that all read the same exchange
    hot = lists.hint("merge")
    found = texts.join(hot, "key").select("key", "text", "rest", "hot").transform(arrow_map, stretches, "g long, d1 long, d2 long, key long, s long, n long")
    found = found.select("g", "d1", "d2", "n", packed(F.col("s")).alias("start")).groupBy("g", "d1", "d2", "n").agg(F.min("start").alias("start"))
    # start is asked for so that this reads the exchange that the join below reads
    differ = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2")) | (F.min("n") != F.max("n")) | F.min("start").isNull()
    kinds = found.groupBy("g").agg(differ.alias("mixed"))
    key, place = unpacked(F.col("start"))
    by_doc = found.join(kinds, "g").select(key.alias("key"), F.struct(place.alias("s"), "n", "d1", "mixed").alias("x")).groupBy("key").agg(F.collect_list("x").alias("x"))
    by_doc = by_doc.select("key", F.col("x.s").alias("ss"), F.col("x.n").alias("ns"), F.col("x.d1").alias("ds"), F.col("x.mixed").alias("ms")).hint("merge")
    some = by_doc.where(F.exists("ms", lambda m: m)).select("key", "ss", "ns", "ms").hint("merge")
    each = texts.join(some, "key").select("key", "text", "rest", "ss", "ns", "ms").transform(arrow_map, windows, "w1 long, w2 long, key long, p long")
    each = each.select("w1", "w2", packed(F.col("p")).alias("start")).groupBy("w1", "w2").agg(F.min("start").alias("start"))
    firsts = each.select(key.alias("key"), F.struct(place.alias("p"), "w1").alias("y")).groupBy("key").agg(F.collect_list("y").alias("y"))
    firsts = firsts.select("key", F.col("y.p").alias("ps"), F.col("y.w1").alias("ws")).hint("merge")
    out = (texts if older is None else keyed).join(hot, "key", "left").join(by_doc, "key", "left").join(firsts, "key", "left")
    done = T.StructType.fromDDL("n_words long, n_removed long, kept string, text string").add("rest", keyed.schema["rest"].dataType)
    return out.select("text", "hot", "ss", "ds", "ms", "ps", "ws", "rest").transform(arrow_map, finish, done)


def _finished(found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    back = F.struct(*[(F.when(~F.col(f"rest.`{_NULL}`"), F.col("text")) if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
    return found.select(F.col(f"rest.`{id_col}`").alias(id_col), "n_words", "n_removed", "kept", back.alias("rest"))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, gram: int = 6, batches: int = 3, max_runs: int = 2, spaced: bool = False
) -> DataFrame:
    """Remove the words covered by a window whose word sequence also starts earlier.

    Words are the runs between ASCII blanks. Earlier is a smaller id, or an earlier start in the
    same document; all windows are judged on the input. Returns the id column, n_words, n_removed
    and kept, the kept words joined by one space (``spaced``: with the blanks that the text has; a run of
    removed words takes those before it along, at the text's ends those on both sides), with the other columns of ``docs`` as ``rest``
    (a struct, so that no name can clash). A null or short text has no window and loses nothing
    (a null one: no words, kept empty). Ids are integers; null ids come before all others. Rows of
    one id are one document in several versions: among them equal windows at the same start do not
    remove each other. An empty table gives no rows.

    The table goes into a new index in ``batches`` of ascending ids, which compacts where it has more
    than ``max_runs`` runs, and the index is deleted. ``Index`` is for keeping one.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    cuts = keyed.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(map(int, cuts)))[: batches - 1]
    index = Index(spark, shared_path(spark, "index"), length, gram, max_runs)
    repeated = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = keyed if low is None else keyed.where(F.col("key") > low)
        some = index.insert(batch if high is None else batch.where(F.col("key") <= high))
        repeated = some if repeated is None else repeated.union(some)
    lists = _lists(index.postings(), repeated)
    index.close(remove=True)
    return _finished(_resolved(keyed, None, lists, length, gram, spaced), docs, id_col, text_col)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_substring": r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(struct_pack(d := doc_id, p := p)) AS f FROM hashed GROUP BY h),
again AS (SELECT doc_id, p FROM hashed JOIN firsts USING (h) WHERE f.d <> doc_id OR f.p <> p),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM again) GROUP BY doc_id),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
kept AS (SELECT one.doc_id, string_agg(one.word, ' ' ORDER BY one.i) AS t, count(*) AS k FROM one
  LEFT JOIN (SELECT doc_id, unnest(g) AS i FROM gone) x ON x.doc_id = one.doc_id AND x.i = one.i WHERE x.i IS NULL GROUP BY one.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
}

"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within the radius r agree in at least one of r + 1 blocks of their 64 bits, so
distinct fingerprints are gathered by block value. Each block value's fingerprints are tiles by
population count, and are compared exactly, with numpy exclusive-or and bit counts, inside a tile
and between two; tile pairs whose counts differ by more than the radius cannot hold a link and
are skipped. A block value that very many fingerprints share is cut into such tiles before, so
that no task gets them all. Tiles give spanning links, not all pairs, and star contractions join these to
components. Equal fingerprints are one row throughout, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, table, text_of
from .graph import components


#: Large keys up to this number (some 100 bytes each) are broadcast to cut their rows; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; of all words in a shorter text; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    shingles = map(joined.__getitem__, map(slice, starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, last)


def fingerprint(text: str, width: int = 3) -> int:
    """Bits set in over half the hashes of the text's word shingles; 0 without words."""
    h = shingle_hashes(text, width)
    bits = sum((np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 65536)), np.zeros(64, np.int64))
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).transform(arrow_map, run, f"`{id_col}` {kind}, fp long")


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least reachable index of each row of a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 256):
            new[at : at + 256] = np.minimum(label[at : at + 256], np.where(linked[at : at + 256], label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(fp: np.ndarray, pop: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indexes) of fingerprints sorted by population count.

    Rows of one count, 128 at most, are a tile; tiles whose counts differ by more than the radius are not compared.
    """
    n = len(fp)
    linked = np.zeros((n, n), bool)
    edges = np.flatnonzero(np.diff(pop, prepend=-1))
    edges = np.unique(np.concatenate([np.arange(a, b, 128) for a, b in zip(edges, [*edges[1:], n])]))
    reach = np.searchsorted(pop, pop[edges] + radius, "right")
    for at, end, to in zip(edges.tolist(), [*edges[1:].tolist(), n], reach.tolist()):
        linked[at:end, at:to] = np.bitwise_count(fp[at:end, None] ^ fp[None, at:to]) <= radius
    linked |= linked.T
    label = _labels(linked)
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def cut_keys(keyed: DataFrame, key: str, kind: str, tile: int, whole: int, weight: Column | None = None) -> DataFrame:
    """(key, tiles) of the keys with more than ``whole`` rows (or of that weight): of each kind (a small number) its tiles ``m`` of about ``tile`` rows."""
    sizes = keyed.groupBy(key, kind).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")).groupBy(key).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct(F.col(kind).alias("kind"), F.ceil(F.col("n") / tile).cast("int").alias("m"))).alias("tiles")
    ).where(F.col("total") > whole).select(key, "tiles")  # at most one entry for each kind
    return checkpointed(sizes)  # few keys as a rule, so that the rows need no shuffle by key


def tiled(keyed: DataFrame, key: str, kind: str, part: str, reach: int, tile: int, whole: int, weight: Column | None = None) -> DataFrame:
    """``keyed`` with a column item: rows of one key meet in an item if their kinds differ by at most ``reach``.

    A key's rows of one kind (a small number) are cut, by a hash of column ``part``, into tiles of
    about ``tile`` rows (or rows of that ``weight``); an item is one tile or a pair of tiles, and
    rows are repeated for every item. Keys of at most ``whole`` rows (or of that weight) are one item.
    """
    sizes = cut_keys(keyed, key, kind, tile, whole, weight)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes
    work = keyed.join(sizes, key, "left")
    own = F.struct(F.col(kind).alias("kind"), F.pmod(F.xxhash64(part), F.filter("tiles", lambda t: t.kind == F.col(kind))[0]["m"]).cast("int").alias("part"))
    near = F.flatten(F.transform(F.filter("tiles", lambda t: F.abs(t.kind - F.col(kind)) <= reach), lambda t: F.transform(F.sequence(F.lit(0), t.m - 1), lambda i: F.struct(t.kind.alias("kind"), i.alias("part")))))
    none = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("part"))
    work = work.withColumn("own", F.when(F.col("tiles").isNull(), none).otherwise(own))
    work = work.withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(none)).otherwise(near)))
    return work.withColumn("item", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("tiles", "own", "other")


def whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, the item, so that no item is cut."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [np.concatenate(parts) for parts in zip(*held, [c[:cut] for c in cols])]
            held = [[c[cut:] for c in cols]]
        elif held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(parts) for parts in zip(*held)]
            held = [cols]
        else:
            held.append(cols)
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def links(fps: DataFrame, radius: int = 3, tile: int = 1024, bits: int = 64) -> DataFrame:
    """Spanning links (u, v) between the distinct values of column fp within the radius."""
    blocks = radius + 1
    edges_at = [bits * i // blocks for i in range(blocks + 1)]
    keys = F.array(*[F.lit(i << 56) + F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) for i, (lo, hi) in enumerate(zip(edges_at, edges_at[1:]))])
    work = tiled(fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(keys).alias("key")), "key", "pop", "fp", radius, tile, tile).select("item", "pop", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, pop, fp in whole_items(batches):
            fp = fp.view(np.uint64)
            u, v = [], []
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            size = np.diff(np.append(start, len(item)))
            small = np.repeat(size <= 32, size)
            for d in range(1, 32):  # all small tiles at once: rows d apart in the same tile
                i = np.flatnonzero(small[:-d] & (item[:-d] == item[d:])) if d < len(item) else []
                if not len(i):
                    break
                i = i[pop[i + d] - pop[i] <= radius]
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
                u.append(fp[i + d]), v.append(fp[i])
            for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist()):
                a, b = tile_links(fp[s : s + n], pop[s : s + n], radius)
                u.append(fp[s + a]), v.append(fp[s + b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)) for x in (u, v)], names=["u", "v"])

    return work.repartition("item").sortWithinPartitions("item", "pop").transform(arrow_map, run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and component of every row.

    Returns the id column, fingerprint (16 hex digits) and component_id, the smallest id reachable
    over links of at most ``radius`` differing bits. A null or empty text has fingerprint zero and
    links like any other; equal fingerprints always link. Repeated rows and ids stay as they are; a
    null id never names a component that has another id. Other columns are not read. An empty
    table gives no rows.
    """
    made = checkpointed(fingerprints(docs, id_col, text_col, width))
    reps = made.groupBy("fp").agg(F.min(id_col).alias("rep"))
    found = components(links(reps.select("fp"), radius))
    named = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = checkpointed(named.join(least, "component").select("fp", "component_id"))
    return made.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

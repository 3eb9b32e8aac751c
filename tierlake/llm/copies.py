"""SimHash near copies at a Jaccard similarity: wide fingerprints, tiles, exact decision.

The 64 bits of ``simhash`` cannot tell a similarity of 0.8 from chance by any radius that blocks of
them could find, so here a text's set of shingles has a SimHash of ``BITS`` bits. Two sets of
similarity 0.8 agree in each bit with a probability of 0.849, hence in one of the 80 blocks of 16
bits with 0.998. Every block value is a tile: its members, sorted by the sizes of their sets, are
compared by exclusive-or and bit counts, and parts whose sizes exclude the similarity are skipped.
Every proposed pair is then decided by the similarity of its two sets of shingles, so nothing
links that is less similar.

A tile proposes at most two links a member: to its nearest neighbour, and to the neighbour with
most neighbours, as a rule the original of its copies. Links whose whole fingerprints are too far
apart go; what the others connect is a cluster, in which all similar sets lie, but not only those.
Proposals need only connect, so they are made in two rounds. Tiles of the first blocks propose as said, which
connects what is dense. Tiles of the other blocks compare the rows that are not connected yet, and those outside
a tile's largest cluster propose, so that a group of near copies, whose members meet in most blocks, proposes no more there. A large value is cut in disjoint parts in the first
round, another cut for each value; in the second, in every block, the rows outside its largest cluster meet
each other and that cluster's parts. So a group's rows and proposals grow with its members, not with its pairs of parts.

So each set is sent once to its cluster (a large one is cut in parts, and sets meet in pairs of
parts), where every pair whose fingerprints allow it is decided, unless it is connected already.
Texts with the same set of shingles are one node throughout, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, text_of
from .graph import components
from .simhash import BROADCAST_KEYS, cut_keys, shingle_hashes, tiled, whole_items

BITS, BLOCK = 1280, 16
WORDS = BITS // 64
#: Words of the fingerprint that go with each of its blocks, and the bits in which a pair may differ there: five deviations
#: above what is expected at a similarity of 0.8 (19 of 128), so one pair in a million is missed.
CARRIED, RADIUS = 2, 40
#: Bits of the whole fingerprint: expected 194 of 1,280, and five deviations.
WIDE_RADIUS = 260
#: Rows of one tile.
TILE = 2048
#: Blocks of the first round; block values of more rows are large.
FIRST_BLOCKS, LARGE = 8, 2048
#: Words of the fingerprint, and bits in which a pair may differ there, between parts of a large value (expected 48 of 320, and five deviations).
MORE_CARRIED, MORE_RADIUS = 5, 81
#: Shingles (and 256 more for every set) of a part of a cluster.
PART = 250_000
#: Proposed nodes up to this number (24 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_NODES = 500_000
_RNG = np.random.default_rng(5)
_ADD = _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; one of all words in a shorter text, none without words."""
    return np.unique(shingle_hashes(text, width))


def _bits_set(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit, by carry-save addition: three rows become a sum and a carry."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > 2:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            odd = a ^ b
            carries.append(a & b | odd & c)
            rows = np.concatenate((odd ^ c, rows[3 * k :]))
        for row in rows:
            total += weight * np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64)
        rows = np.concatenate(carries) if carries else rows[:0]
        weight *= 2
    return total


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set: of WORDS words, each bit 1 if set in over half the set's mixed hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        h = (hashes[at : at + 4096, None] ^ _ADD) * _TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        count += _bits_set(h)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def nodes(rows: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """(r1, r2, node, size, fp) of rows keyed by r1 and r2; fp is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, fps = [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_set(text, width)
                names.append(xxhash.xxh64_intdigest(h.tobytes()))
                sizes.append(len(h))
                fps.append(wide_fingerprint(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(names), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())], names=["r1", "r2", "node", "size", "fp"])

    return rows.select("r1", "r2", text_of(text_col).alias("text")).transform(arrow_map, run, "r1 long, r2 long, node long, size int, fp binary")


def _blocks(made: DataFrame, begin: int = 0, end: int = BITS // BLOCK, carried: int = CARRIED) -> DataFrame:
    """(key, node, size, label, fp words carried) once for each of some blocks of a node's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = end - begin
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WORDS)
            key = fp.view(np.uint16)[:, begin:end].astype(np.int64) | np.arange(begin, end) << BLOCK
            cols = [key.ravel(), *(np.repeat(batch.column(i).to_numpy(), per) for i in range(3))]
            cols += [np.repeat(fp[:, i].view(np.int64), per) for i in range(carried)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "size", "label", *(f"f{i}" for i in range(carried))])

    return made.select("node", "size", "label", "fp").transform(arrow_map, run, ", ".join(("key long, node long, size int, label long", *(f"f{i} long" for i in range(carried)))))


def _own_tiles(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """``keyed`` with a column item: a value is one item; ``large`` ones are cut by class and hash, another hash for each value."""
    work = keyed.join(large, "key", "left")
    part = F.pmod(F.xxhash64("node", "key"), F.filter("tiles", lambda t: t.kind == F.col("class"))[0]["m"])
    return work.withColumn("item", F.when(F.col("tiles").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", "class", part))).drop("tiles")


def _rest_tiles(members: DataFrame) -> DataFrame:
    """Rows (key, node, size, class, label) of large values with columns item and rest: rows of one value, of classes at most one apart and of different labels meet in an item.

    A band of a value has two neighbouring classes. The rows outside the label that has most rows of the band are its rest; the
    rest's parts meet each part of that label, and each other. A band of one label has no item.
    """
    rows = members.withColumn("band", F.explode(F.array("class", F.col("class") + 1))).drop("class")
    held = rows.groupBy("key", "band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "band").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("main"))
    parts = lambda n: F.ceil(n / TILE).cast("int")
    mixed = checkpointed(held.where("labels > 1").select("key", "band", F.col("main.label").alias("main"), parts(F.col("main.n")).alias("mains"), parts(F.col("total") - F.col("main.n")).alias("rests")))
    work = rows.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_KEYS else mixed, ["key", "band"]).withColumn("rest", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("node", "key"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    work = work.withColumn("own", own)
    with_main = F.transform(upto("mains"), lambda i: pair(0, i, F.col("own")))
    with_rest = F.transform(F.filter(upto("rests"), lambda i: i != F.col("own")), lambda i: pair(1, F.least(i, "own"), F.greatest(i, "own")))
    work = work.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(with_main, with_rest)).otherwise(F.transform(upto("rests"), lambda i: pair(0, F.col("own"), i)))))
    return work.select(F.xxhash64("key", "band", "at.kind", "at.a", "at.b").alias("item"), "node", "size", "label", "rest")


def crossings(size: np.ndarray, fp: np.ndarray, label: np.ndarray, rest: np.ndarray, least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, other) of different labels: every row's nearest one of the rest, and the nearest one outside it of every row of the rest."""
    none, main = 1 << 14, np.flatnonzero(~rest)
    best, to = np.full(len(size), none, np.int16), np.zeros(len(size), np.int64)
    rows, others = [], []
    own = np.flatnonzero(rest)
    for at in range(0, len(own), 256):
        i = own[at : at + 256]
        differ = np.zeros((len(i), len(size)), np.int16)
        for k in range(fp.shape[1]):
            differ += np.bitwise_count(fp[i, None, k] ^ fp[None, :, k])
        small, large = np.minimum(size[i, None], size[None]), np.maximum(size[i, None], size[None])
        differ[(differ > radius) | (label[i, None] == label[None]) | (small + 1e-9 < least * large)] = none
        nearest = differ.argmin(0)
        found = differ[nearest, np.arange(len(size))]
        better = found < best
        best[better], to[better] = found[better], i[nearest[better]]
        if len(main):
            nearest = main[differ[:, main].argmin(1)]
            hit = differ[np.arange(len(i)), nearest] < none
            rows.append(i[hit]), others.append(nearest[hit])
    hit = np.flatnonzero(best < none)
    return np.concatenate([*rows, hit]), np.concatenate([*others, to[hit]])


def _crossing(tiles: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (u, v), u > v, of nodes of different labels that rows of tiles propose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, node, size, label, rest, fp in whole_items(batches):
            fp = np.frombuffer(b"".join(fp), np.uint64).reshape(len(item), -1)
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(item)]):
                a, b = crossings(size[s:e], fp[s:e], label[s:e], rest[s:e].astype(bool), least, MORE_RADIUS)
                u.append(node[s + a]), v.append(node[s + b])
            u, v = np.concatenate(u), np.concatenate(v)
            pair = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    words = distinct.select("node", F.substring("fp", 1, 8 * MORE_CARRIED).alias("words"))
    rows = tiles.join(words, "node").select("item", "node", "size", "label", "rest", "words")
    return rows.repartition("item").sortWithinPartitions("item", "size", "node").transform(arrow_map, run, "u long, v long").distinct()


def close(size: np.ndarray, fp: np.ndarray, least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a tile, sorted by size, may be similar, and their differing bits; parts whose sizes exclude it are not compared."""
    n = len(size)
    out, bits = np.zeros((n, n), bool), np.zeros((n, n), np.int16)
    for at in range(0, n, 128):
        end = min(n, at + 128)
        to = int(np.searchsorted(size, size[end - 1] / least + 1e-9, "right"))
        differ = bits[at:end, at:to]
        for i in range(fp.shape[1]):
            differ += np.bitwise_count(fp[at:end, None, i] ^ fp[None, at:to, i])
        small, large = np.minimum(size[at:end, None], size[None, at:to]), np.maximum(size[at:end, None], size[None, at:to])
        out[at:end, at:to] = (differ <= radius) & (small + 1e-9 >= least * large)
    out |= out.T
    np.fill_diagonal(out, False)
    return out, np.maximum(bits, bits.T)


def proposals(linked: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, other): every row's nearest neighbour and its neighbour with most neighbours; the first of equals."""
    n = len(linked)
    degree = linked.sum(1, dtype=np.int64)
    rows = np.flatnonzero(degree)
    others = [np.empty(0, np.int64)]
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        others.append(np.where(linked[some], differ[some], 1 << 14).argmin(1))
    for at in range(0, len(rows), 256):
        others.append(np.where(linked[rows[at : at + 256]], degree, -1).argmax(1))
    return np.concatenate((rows, rows)), np.concatenate(others)


def _small_proposals(item: np.ndarray, small: np.ndarray, size: np.ndarray, label: np.ndarray, fp: np.ndarray, least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``proposals`` for all small tiles at once, by pairs of rows d apart in the same tile."""
    first, second, differ = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, 32):
        i = np.flatnonzero(small[:-d] & (item[:-d] == item[d:])) if d < len(item) else []
        if not len(i):
            break
        i = i[(size[i] + 1e-9 >= least * size[i + d]) & (label[i] != label[i + d])]
        apart = np.bitwise_count(fp[i] ^ fp[i + d]).sum(1, dtype=np.int64)
        i, apart = i[apart <= radius], apart[apart <= radius]
        first.append(i), second.append(i + d), differ.append(apart)
    a, b, apart = np.concatenate(first), np.concatenate(second), np.concatenate(differ)
    degree = np.bincount(a, minlength=len(item)) + np.bincount(b, minlength=len(item))
    row, other, apart = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((apart, apart))
    found = []
    for order in (np.lexsort((other, apart, row)), np.lexsort((other, -degree[other], row))):
        top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        found.append((row[top], other[top]))
    return np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])


def in_largest(item: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which rows have the label that is most frequent in their item, where that is on two rows or more; rows are sorted by item."""
    by = np.lexsort((label, item))
    first = np.flatnonzero((np.diff(item[by], prepend=0) != 0) | (np.diff(label[by], prepend=0) != 0) | (np.arange(len(by)) == 0))
    count = np.diff(np.append(first, len(by)))
    order = np.lexsort((-count, item[by][first]))
    runs = item[by][first][order]
    top = order[np.concatenate(([True], runs[1:] != runs[:-1]))]
    largest = np.zeros(len(first), bool)
    largest[top] = count[top] > 1
    out = np.empty(len(item), bool)
    out[by] = np.repeat(largest, count)
    return out


def _proposed(tiles: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (u, v), u > v, of nodes of different labels that rows of tiles propose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, node, size, label, *words in whole_items(batches):
            fp = np.stack([w.view(np.uint64) for w in words], 1)
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            count = np.diff(np.append(start, len(item)))
            a, b = _small_proposals(item, np.repeat(count <= 32, count), size, label, fp, least, RADIUS)
            rows, others = [a], [b]
            for s, n in zip(start[count > 32].tolist(), count[count > 32].tolist()):
                own = label[s : s + n]
                if (own == own[0]).all():
                    continue
                linked, differ = close(size[s : s + n], fp[s : s + n], least, RADIUS)
                a, b = proposals(linked & (own[:, None] != own), differ)
                rows.append(s + a), others.append(s + b)
            a, b = np.concatenate(rows), np.concatenate(others)
            propose = ~in_largest(item, label)[a]
            u, v = node[a[propose]], node[b[propose]]
            pair = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), 1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    rows = tiles.select("item", "node", "size", "label", *(f"f{i}" for i in range(CARRIED))).repartition("item").sortWithinPartitions("item", "size", "node")
    return rows.transform(arrow_map, run, "u long, v long").distinct()


def _near(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose whole fingerprints are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, WORDS) for i in (2, 3))
            keep = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= WIDE_RADIUS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    side = lambda end, name: distinct.select(F.col("node").alias(end), F.col("fp").alias(name))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").transform(arrow_map, run, "u long, v long")


def spanning(size: np.ndarray, fp: np.ndarray, sets: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, other) of similarity ``least`` or more that connect what all such links connect; rows sorted by size."""
    linked, _ = close(size, fp, least, WIDE_RADIUS)
    values = np.frombuffer(b"".join(sets), np.uint64)
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    label = np.arange(len(size))
    rows, others = [], []
    for i in range(len(size) - 1):
        near = i + 1 + np.flatnonzero(linked[i, i + 1 :])
        near = near[label[near] != label[i]]
        if not len(near):
            continue
        own = values[at[i] : at[i + 1]]
        count = size[near].astype(np.int64)
        begin = np.cumsum(count) - count
        theirs = values[np.repeat(at[near] - begin, count) + np.arange(int(count.sum()))]
        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        both = np.add.reduceat((own[place] == theirs).astype(np.int64), begin)
        for j in near[both >= least * (len(own) + count - both) - 1e-9].tolist():
            if label[j] != label[i]:
                rows.append(i), others.append(j)
                label[label == label[j]] = label[i]
    return np.array(rows, np.int64), np.array(others, np.int64)


def _decided(clusters: DataFrame, made: DataFrame, rows: DataFrame, text_col: str, width: int, least: float, kind: Column) -> DataFrame:
    """Spanning links (u, v) of similarity ``least`` or more among the nodes (node, cluster, size, fp) of clusters."""
    reps = checkpointed(made.join(clusters.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("r")).select("node", "r.r1", "r.r2"))
    few = reps.count() <= BROADCAST_NODES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = rows.select("r1", "r2", text_of(text_col).alias("text")).join(F.broadcast(reps) if few else reps, ["r1", "r2"]).select("node", "text")
    sets = texts.transform(arrow_map, gather, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))  # equal nodes have equal sets
    parts = tiled(clusters.withColumn("class", kind), "cluster", "class", "node", 1, PART, PART, F.col("size") + 256).select("item", "node", "size", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, node, size, fp, sets in whole_items(batches):
            words = np.frombuffer(b"".join(fp), np.uint64).reshape(-1, WORDS)
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(item)]):
                a, b = spanning(size[s:e], words[s:e], sets[s:e].tolist(), least)
                u.append(node[s + a]), v.append(node[s + b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    held = parts.join(sets, "node").select("item", "node", "size", "fp", "set")
    return held.repartition("item").sortWithinPartitions("item", "size", "node").transform(arrow_map, run, "u long, v long")


def copies(rows: DataFrame, text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(r1, r2, component) for rows keyed by r1 and r2 (equal keys only for equal texts).

    Component: rows reachable over links of a similarity of ``least`` or more between the sets of
    ``width``-word shingles. A text of fewer words has one shingle of all its words; null texts and
    those without words are copies of each other. An empty table gives no rows. The constants of
    this module are set for 0.8; at a larger ``least`` they miss fewer pairs, at a smaller one more.
    """
    made = checkpointed(nodes(rows, text_col, width))
    distinct = checkpointed(made.where(F.col("fp").isNotNull()).groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp")))
    kind = F.floor(F.log("size") / -np.log(least)).cast("int")  # similar sets have classes at most one apart
    alone = distinct.withColumn("label", F.col("node"))
    large = cut_keys(_blocks(alone, carried=0).withColumn("class", kind), "key", "class", TILE, LARGE)
    count = large.count()
    large = F.broadcast(large) if count <= BROADCAST_KEYS else large
    first = _own_tiles(_blocks(alone, 0, FIRST_BLOCKS).withColumn("class", kind), large)
    connected = components(_near(checkpointed(_proposed(first, least)), distinct))
    labelled = checkpointed(distinct.join(connected, "node", "left").select("node", "size", "fp", F.coalesce("component", "node").alias("label")))
    pairs = _proposed(_blocks(labelled, FIRST_BLOCKS).join(large, "key", "left_anti").withColumn("item", F.xxhash64("key")), least)
    if count:
        members = checkpointed(_blocks(labelled, carried=0).join(large, "key", "left_semi").withColumn("class", kind))
        pairs = pairs.union(_crossing(_rest_tiles(members), distinct, least)).distinct()
    more = _near(checkpointed(pairs), distinct)
    connected = components(connected.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    clusters = checkpointed(connected.withColumnRenamed("component", "cluster").join(distinct, "node"))
    found = components(_decided(clusters, made, rows, text_col, width, least, kind))
    return made.join(found, "node", "left").select("r1", "r2", F.coalesce("component", "node").alias("component"))

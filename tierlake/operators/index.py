"""Inverted index over the four searchable tiers: postings with places, document lengths and corpus figures.

A searchable document is a row (tier, tenant_id, category, key, seq, parts, text, body, ts); ``parts``
are the texts that are indexed, ``text`` is all of them. One analyzer makes the terms of documents
and of queries. The index is derived data: it is built once, saved, and read by every query;
``Segments`` keeps one beside a store's logs, where only what is new since the last time is indexed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import porter
from ..functions import text as tx
from ..sources.manifest import Manifest
from ..sources.tables import small

TIERS = ("entity", "state", "reference", "journal")


def searchable(entities: DataFrame | None = None, state: DataFrame | None = None, reference: DataFrame | None = None, journal: DataFrame | None = None) -> DataFrame:
    """One table of searchable documents from the live tiers; a tier that is left out has no branch in the plan."""
    nothing = F.lit(None).cast("string")
    out = None
    for tier, df, category, key, texts, body, ts in (
        ("entity", entities, F.col("category"), F.col("name"), ["name", "category", "body"], F.col("body"), F.col("updated_at")) if entities is not None else ("", None, *[nothing] * 5),
        ("state", state, nothing, F.col("document_key"), ["document_key", "body"], F.col("body"), F.col("updated_at")) if state is not None else ("", None, *[nothing] * 5),
        ("reference", reference, nothing, F.col("doc_key"), ["doc_key", "body"], F.col("body"), F.col("updated_at")) if reference is not None else ("", None, *[nothing] * 5),
        ("journal", journal, nothing, F.col("id"), ["evaluated", "acted", "forward", "extra"], nothing, F.col("ts")) if journal is not None else ("", None, *[nothing] * 5),
    ):
        if df is None:
            continue
        parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in texts])
        text = F.concat_ws(" ", parts)
        if tier == "journal":
            body = F.to_json(F.struct(*[F.col(c) for c in texts]), {"ignoreNullFields": "false"})
        part = df.select(F.lit(tier).alias("tier"), "tenant_id", category.alias("category"), key.alias("key"), "seq", parts.alias("parts"), text.alias("text"), body.alias("body"), ts.alias("ts"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tier to search")
    return out


@dataclass(frozen=True)
class Analyzer:
    """``query``: the terms of one query word; ``words``: of a text its words in order, or else ``column``; ``stem``: of a word its terms.

    ``stem`` sees each distinct word once: postings of words are joined with a dictionary of them.
    """

    name: str
    query: Callable[[str], list[str]]
    words: Callable[[str], list[str]] | None = None
    stem: Callable[[str], list[str]] | None = None
    column: Callable[[Column], Column] | None = None


#: Case, diacritics and inflections do not count, and underscores split; distinct words are stemmed.
PORTER = Analyzer("porter", porter.terms, porter.words, lambda w: [porter.porter(w)])
#: Lower-cased words as they stand.
WORDS = Analyzer("words", lambda w: [w.lower()], tx.words)
_KNOWN = {a.name: a for a in (PORTER, WORDS)}


@dataclass
class Grams:
    """Trigram postings of the folded texts: (tier, gram, seqs, tenants, sizes, places), and (tier, n_docs, size) of the texts.

    A row has a gram's documents of one block of texts; ``places`` are where it begins in each. Texts end with two
    blanks that no text has, so that one gram begins at every place, the last ones included.
    """

    postings: DataFrame
    stats: DataFrame
    dead: DataFrame | None = None  # (tier, seq) of documents that do not count


#: Fixed kind of a trigram's rows; PAD ends every text.
_GRAMS = "tier string, gram string, seqs array<long>, tenants array<string>, sizes array<int>, places array<array<int>>"
PAD = "\0"
#: Characters of texts that are cut into trigrams at once, and documents of a block of postings.
GRAM_CHARS, BLOCK_DOCS = 2 << 20, 64
#: Terms of fewer documents have no block maxima: all their postings are read.
COMMON = 256


@dataclass
class Index:
    """``postings``: (tier, tenant_id, seq, term, tf, dl, pos); ``stats``: (tier, n_docs, avgdl); ``docs``: the documents.

    Postings of stems have ``forms`` as well, the words that they stand for.
    A saved index has more: ``grams``; ``words``, its dictionary (word, terms); postings have the ``block`` of their document, and
    ``blocks`` has (tier, term, block, n, best) of each block of a common term: its postings, and the most that one of
    them can add to a rank, by the index's mean length.
    """

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    analyzer: Analyzer = PORTER
    grams: Grams | None = None
    words: DataFrame | None = None
    blocks: DataFrame | None = None
    raw: DataFrame | None = None
    size: int | None = None
    source: DataFrame | None = None

    def save(self, path: str, buckets: int = 64, known: DataFrame | None = None, grams: bool = True, copy: bool = True) -> Index:
        """Write the index and return it as read back; term order lets a term's scan skip row groups and pages.

        Postings stay with their documents: those of one part of the documents are a file, sorted by term, and no posting is shuffled.
        ``known`` is the dictionary of an earlier index: only words that it does not have are stemmed, and postings go by term to be joined with it.
        Without ``grams`` there are no trigram postings, and substring search scans the texts. Without ``copy`` the
        documents are read where they are, which suits tables that do not change.
        """
        spark = self.docs.sparkSession
        docs = self.docs
        if copy:
            docs.write.mode("overwrite").partitionBy("tier").parquet(f"{path}/docs")
            docs = spark.read.parquet(f"{path}/docs")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        if self.source is not None and self.analyzer.words is not None and known is None:
            sharded(self.source, self.analyzer, buckets).write.mode("overwrite").parquet(f"{path}/postings")
            words = None if self.analyzer.stem is None else dictionary(read("postings"))
        else:
            words = self._by_term(path, buckets, known)
        postings = read("postings")
        _stats(docs, postings, ("tier",)).write.mode("overwrite").parquet(f"{path}/stats")  # from what is written, not from the texts again
        held = saved_grams(docs, f"{path}/grams", buckets) if grams else None
        return Index(docs, postings.drop("head"), read("stats"), self.analyzer, held, words, maxima(postings, read("stats")))

    def _by_term(self, path: str, buckets: int, known: DataFrame | None) -> DataFrame | None:
        """Postings dealt out by term, of words that a dictionary stems or that are made as a column; returns the dictionary."""
        spark = self.docs.sparkSession
        (self.postings if self.raw is None else self.raw).write.mode("overwrite").parquet(f"{path}/raw")
        raw, words = spark.read.parquet(f"{path}/raw"), None
        postings = raw
        if self.raw is not None and self.analyzer.stem is not None:
            stemmed(raw.select("term"), self.analyzer, known).write.mode("overwrite").parquet(f"{path}/words")
            words = spark.read.parquet(f"{path}/words")
            postings = by_dictionary(raw, words, buckets)
        else:
            postings = postings.repartition(buckets, "term")
        blocked(postings, raw).sortWithinPartitions("term", "block").write.mode("overwrite").partitionBy("tier").parquet(f"{path}/postings")
        delete(spark, f"{path}/raw")
        return words

    def documents(self) -> int:
        """How many documents there are, read once."""
        if self.size is None:
            self.size = self.stats.agg(F.sum("n_docs")).first()[0] or 0
        return self.size

    def substrings(self) -> Grams | DataFrame:
        """What substring search reads: the trigram postings of a saved index, else the folded texts."""
        return folded(self.docs) if self.grams is None else self.grams


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _analyzer(terms: Analyzer | Callable[[Column], Column]) -> Analyzer:
    if isinstance(terms, Analyzer):
        return terms
    if terms is porter.terms_col:
        return PORTER
    return WORDS if terms is tx.words_col else Analyzer("own", lambda w: [w], column=terms)


def words_of(docs: DataFrame, analyzer: Analyzer, keep: tuple[str, ...] = ("tier", "tenant_id")) -> DataFrame:
    """(tier, tenant_id, seq, term, tf, dl, pos) of documents with their parts, with words as they stand in the texts as terms.

    Documents are dealt out once, by number, as a large file with few row groups is few tasks; their words are counted where they are.
    """
    parts = F.col("parts") if "parts" in docs.columns else F.array("text")
    names = [*keep, "seq"]
    rows = docs.select(*names, parts.alias("parts")).repartition("seq")
    if analyzer.words is not None:
        kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
        return rows.mapInArrow(_counted(analyzer.words, names), f"{kinds}, term string, tf int, dl int, pos array<int>")
    gap = F.array(F.lit(""))  # between columns
    terms = F.flatten(F.transform("parts", lambda p: F.concat(analyzer.column(p), gap)))
    rows = rows.select(*names, terms.alias("terms")).withColumn("dl", F.size(F.filter("terms", lambda t: t != "")))
    placed = rows.select(*names, "dl", F.posexplode("terms").alias("pos", "term")).where("term <> ''")
    made = placed.groupBy(*names, "term", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("pos"))
    return made.select(*names, "term", "tf", "dl", "pos")


#: Words of documents that are counted and sorted at once.
COUNTED_WORDS = 2_000_000
#: Words that are numbered at once, and postings that are handed on at once.
NUMBERED_WORDS, HANDED_ON = 200_000, 50_000
_FORMS = "array<struct<word string, pos array<int>>>"


class _Run:
    """Words of some documents with their places, as numbers, until they are handed on sorted by term."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.docs, self.lengths, self.size = [], [], 0
        self.codes, self.owners, self.places = [], [], []
        self.words, self.spans = [], []  # not yet numbered: words, and (document, first place, how many) of each column

    def add(self, doc: tuple, columns: list[list[str]]) -> None:
        """A gap between columns keeps phrases inside one."""
        at = 0
        for words in columns:
            self.spans.append((len(self.docs), at, len(words)))
            self.words += words
            at += len(words) + 1
        self.docs.append(doc)
        self.lengths.append(at - len(columns))
        self.size += self.lengths[-1]
        if len(self.words) >= NUMBERED_WORDS:
            self.number()

    def number(self) -> None:
        codes, found = pd.factorize(np.array(self.words, object))
        numbers = self.numbers
        self.codes.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)[codes] if len(found) else np.empty(0, np.int64))
        owner, first, count = np.array(self.spans, np.int64).reshape(-1, 3).T
        self.owners.append(np.repeat(owner, count))
        self.places.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count))
        self.words, self.spans = [], []

    def postings(self, stem: Callable[[str], list[str]] | None, order: np.ndarray) -> tuple:
        """(documents, terms, counts, places, forms) sorted by term, then by the documents' ``order``; forms only with stems."""
        self.number()
        code, owner, place = (np.concatenate(x) for x in (self.codes, self.owners, self.places))
        words = list(self.numbers)
        made = [[w] for w in words] if stem is None else [stem(w) for w in words]
        ids, terms = pd.factorize(np.array([t for ts in made for t in ts], object), sort=True)
        many = np.array([len(ts) for ts in made], np.int64)
        begin, times = (np.cumsum(many) - many)[code], many[code]
        if (times != 1).any():  # terms of one word share its places
            again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            term = ids[np.repeat(begin, times) + again]
            code, owner, place = (np.repeat(x, times) for x in (code, owner, place))
        else:
            term = ids[begin]
        key = term * len(self.docs) + order[owner]
        by = np.argsort(key, kind="stable")  # places of a term in a document stay in order
        key, code, owner, place, term = key[by], code[by], owner[by], place[by], term[by]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(new, len(key)))
        term_of = pa.array(terms, pa.string()).take(pa.array(term[new]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)).astype(np.int32)), pa.array(place.astype(np.int32)))
        return owner[new], term_of, count, lists, None if stem is None else self.forms(words, terms, code, place, term, new, count)

    @staticmethod
    def forms(words: list[str], terms: np.ndarray, code: np.ndarray, place: np.ndarray, term: np.ndarray, new: np.ndarray, count: np.ndarray) -> pa.Array:
        """Of each posting the words that it stands for, each with its places; null where the term itself is the only one."""
        numbers = {w: i for i, w in enumerate(words)}
        own = np.array([numbers.get(t, -1) for t in terms], np.int64)
        other = np.add.reduceat((code != own[term]).astype(np.int64), new) > 0 if len(new) else np.empty(0, bool)
        some = np.repeat(other, count)
        group, code, place = np.repeat(np.arange(len(new)), count)[some], code[some], place[some]
        by = np.lexsort((code, group))
        group, code, place = group[by], code[by], place[by]
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        held = pa.StructArray.from_arrays(
            [pa.array(words, pa.string()).take(pa.array(code[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))], ["word", "pos"]
        )
        offsets = np.concatenate(([0], np.cumsum(np.bincount(group[first], minlength=len(new))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), held, mask=pa.array(~other))


#: Of the postings of one term and block how many they are, the most occurrences, and the shortest document; on the first of them.
_HEAD = "struct<n: int, tf: int, dl: int>"


def _heads(tier: np.ndarray, block: np.ndarray, term: pa.Array, count: np.ndarray, length: np.ndarray) -> pa.Array:
    if not len(count):
        return pa.nulls(0, pa.struct([(n, pa.int32()) for n in ("n", "tf", "dl")]))
    term = term.dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tier, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    figures = [np.zeros(len(count), np.int32) for _ in range(3)]
    for to, found in zip(figures, (np.diff(np.append(new, len(count))), np.maximum.reduceat(count, new), np.minimum.reduceat(length, new))):
        to[new] = found
    mask = np.ones(len(count), bool)
    mask[new] = False
    return pa.StructArray.from_arrays([pa.array(f) for f in figures], ["n", "tf", "dl"], mask=pa.array(mask))


def _counted(words: Callable[[str], list[str]], names: list[str], stem: Callable[[str], list[str]] | None = None) -> Callable:
    """A map over batches of (names, parts): each document's words, or their stems, with their places, in runs sorted by term and ``names`` from the last."""

    def made(run: _Run, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        keys = [pa.array([d[i] for d in run.docs], schema.field(n).type) for i, n in enumerate(names)]
        sort = pa.Table.from_arrays([*keys, pa.array(range(len(run.docs)))], [*names, "_at"]).sort_by([(n, "ascending") for n in (*reversed(names), "_at")])
        order = np.empty(len(run.docs), np.int64)
        order[sort.column("_at").to_numpy()] = np.arange(len(run.docs))
        owner, term, count, places, forms = run.postings(stem, order)
        length, rows = np.array(run.lengths, np.int64)[owner], pa.array(owner)
        columns = [k.take(rows) for k in keys] + [term, pa.array(count, pa.int32()), pa.array(length, pa.int32()), places] + ([] if forms is None else [forms])
        named = [*names, "term", "tf", "dl", "pos", *([] if forms is None else ["forms"])]
        if "block" in names:
            columns.append(_heads(keys[names.index("tier")].dictionary_encode().indices.to_numpy()[owner], keys[names.index("block")].to_numpy()[owner], term, count, length))
            named.append("head")
        batch = pa.RecordBatch.from_arrays(columns, names=named)
        for at in range(0, batch.num_rows, HANDED_ON):
            yield batch.slice(at, HANDED_ON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = _Run(), None
        for batch in batches:
            schema = batch.schema
            docs = zip(*(batch.column(n).to_pylist() for n in names)) if names else iter([()] * batch.num_rows)
            for doc, parts in zip(docs, batch.column("parts").to_pylist()):
                now.add(doc, [words(p) for p in parts])
                if now.size >= COUNTED_WORDS:
                    yield from made(now, schema)
                    now = _Run()
        if now.docs:
            yield from made(now, schema)

    return run


#: Characters of the documents whose postings, or trigrams, are one file at most where more than the asked number of files would be needed.
SHARD_CHARS = 32 << 20
#: Characters of a block of documents, about.
BLOCK_CHARS = 4 << 20


def _shards(chars: int, buckets: int) -> int:
    return max(buckets, -(-chars // SHARD_CHARS))


def sharded(docs: DataFrame, analyzer: Analyzer, buckets: int) -> DataFrame:
    """Postings of documents with the block of their document, made and sorted where the documents are dealt to.

    A block is of documents of about the same number of characters, BLOCK_DOCS in a block by a hash of their number, and of long ones fewer.
    Its documents are dealt out together, so that what is to be known of its postings is known there.
    """
    chars = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    rows = docs.select("tier", "tenant_id", "seq", "parts", chars.alias("chars")).withColumn("step", F.floor(4 * F.log2(F.col("chars") + 1.0)).cast("long"))
    # a row for each power of the fourth root of two
    found = rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()
    many = lambda r: max(-(-r["n"] // BLOCK_DOCS), -(-r["chars"] // BLOCK_CHARS))
    sizes = small(docs.sparkSession, [(r["step"], many(r)) for r in found], "step long, many long")
    block = F.col("step") * (1 << 40) + F.pmod(F.xxhash64("seq"), F.col("many"))
    rows = rows.join(F.broadcast(sizes), "step").select(block.alias("block"), "tenant_id", "seq", "tier", "parts")
    names = ["tenant_id", "seq", "block", "tier"]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}, term string, tf int, dl int, pos array<int>" + ("" if analyzer.stem is None else f", forms {_FORMS}") + f", head {_HEAD}"
    made = rows.repartition(_shards(sum(r["chars"] for r in found), buckets), "block").mapInArrow(_counted(analyzer.words, names, analyzer.stem), schema)
    return made.select("tier", "tenant_id", "seq", "term", "tf", "dl", "pos", *([] if analyzer.stem is None else ["forms"]), "block", "head")


def dictionary(postings: DataFrame) -> DataFrame:
    """(word, terms): the words that postings of stems stand for."""
    word = F.explode(F.coalesce(F.transform("forms", lambda f: f["word"]), F.array("term")))
    return postings.select(word.alias("word"), "term").groupBy("word").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def stemmed(words: DataFrame, analyzer: Analyzer, known: DataFrame | None = None) -> DataFrame:
    """(word, terms): the dictionary of the distinct words in the column; only those that ``known`` does not have reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0)
            yield pa.RecordBatch.from_arrays([word, pa.array([analyzer.stem(w) for w in word.to_pylist()], pa.list_(pa.string()))], names=["word", "terms"])

    new = words.select(words.columns[0]).distinct().toDF("word")
    if known is None:
        return new.mapInArrow(run, "word string, terms array<string>")
    return new.join(known.select("word"), "word", "left_anti").mapInArrow(run, "word string, terms array<string>").unionByName(known.join(new, "word", "left_semi"))


def by_dictionary(raw: DataFrame, words: DataFrame, buckets: int | None = None) -> DataFrame:
    """Postings of words as postings of the dictionary's terms; words of one term are joined. Terms of one word share its places.

    ``forms`` are the words that a posting stands for, each with its places; null where the term itself is the only one.
    """
    names = [c for c in raw.columns if c not in ("term", "tf", "pos")]
    found = raw.join(words, raw["term"] == words["word"]).select(*names, F.explode("terms").alias("term"), "word", "pos")
    found = found.repartition("term") if buckets is None else found.repartition(buckets, "term")
    made = found.groupBy(*names, "term").agg(F.collect_list(F.struct("word", "pos")).alias("forms"))
    plain = (F.size("forms") == 1) & (F.col("forms")[0]["word"] == F.col("term"))
    made = made.withColumn("pos", F.sort_array(F.flatten("forms.pos")))
    return made.select(*[c for c in names if c != "dl"], "term", F.size("pos").alias("tf"), "dl", "pos", F.when(~plain, F.col("forms")).alias("forms"))


def postings_of(docs: DataFrame, analyzer: Analyzer, keep: tuple[str, ...] = ("tier", "tenant_id"), known: DataFrame | None = None) -> DataFrame:
    """(tier, tenant_id, seq, term, tf, dl, pos) of documents with their parts, and ``forms`` where terms are stems."""
    raw = words_of(docs, analyzer, keep)
    return raw if analyzer.stem is None else by_dictionary(raw, stemmed(raw.select("term"), analyzer, known))


def blocked(postings: DataFrame, every: DataFrame) -> DataFrame:
    """Postings with the block of their document: those of about the same length, BLOCK_DOCS in a block by a hash of their number.

    ``every`` has all postings and is only counted.
    """
    step = F.floor(4 * F.log2(F.col("dl") + 1.0)).cast("long")
    docs = every.select("tier", "seq", step.alias("step")).distinct()
    sizes = docs.groupBy("tier", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("many"))  # a row for each power of the fourth root of two
    rows = postings.withColumn("step", step).join(F.broadcast(sizes), ["tier", "step"])
    return rows.withColumn("block", F.col("step") * (1 << 40) + F.pmod(F.xxhash64("seq"), F.col("many"))).select(*postings.columns, "block")


def maxima(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(tier, term, block, n, best): of each block of a common term's postings their number, and the most that a posting in it can weigh.

    Asked for some terms, it reads these alone. Where postings have heads, the most frequent occurrence in the shortest document is the bound.
    """
    rows = postings.select("tier", "term", "block", F.lit(1).alias("n"), "tf", "dl")
    if "head" in postings.columns:
        rows = postings.where(F.col("head").isNotNull()).select("tier", "term", "block", "head.*")
    rows = rows.join(F.broadcast(stats.select("tier", "avgdl")), "tier")
    found = rows.groupBy("tier", "term", "block").agg(F.sum("n").alias("n"), F.max(weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("best"))
    return found.withColumn("df", F.sum("n").over(Window.partitionBy("tier", "term"))).where(F.col("df") >= COMMON).drop("df")


def grams_of(docs: DataFrame) -> DataFrame:
    """Trigram postings of the documents' folded texts, as a map over the texts: a row for each gram of a block of them.

    A text longer than a block is cut, and then has its gram in several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size = 0
        for batch in batches:
            for tier, tenant, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
                points = np.frombuffer((text + 2 * PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
                for at in range(0, max(1, len(points) - 2), GRAM_CHARS):
                    part.append((tier, tenant, seq, len(text), at, points[at : at + GRAM_CHARS + 2]))
                    size += len(part[-1][5])
                    if size >= GRAM_CHARS:
                        yield from _gram_rows(part)
                        part, size = [], 0
        if part:
            yield from _gram_rows(part)

    return docs.select("tier", "tenant_id", "seq", tx.fold_col(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, _GRAMS)


def _gram_rows(part: list[tuple]) -> Iterator[pa.RecordBatch]:
    for tier in sorted({p[0] for p in part}):
        own = [p for p in part if p[0] == tier]
        sizes = np.array([max(0, len(p[5]) - 2) for p in own])
        code = np.concatenate([(p[5][:-2].astype(np.int64) << 42) | (p[5][1:-1].astype(np.int64) << 21) | p[5][2:] for p in own])
        if not len(code):
            continue
        owner = np.repeat(np.arange(len(own)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes - np.array([p[4] for p in own]), sizes)
        order = np.argsort(code, kind="stable")  # within a gram by text, then by place
        code, owner, place = code[order], owner[order], place[order].astype(np.int32)
        new_gram = np.diff(code, prepend=-1) != 0
        new_doc = new_gram | (np.diff(owner, prepend=-1) != 0)
        docs, starts = owner[new_doc], np.flatnonzero(new_doc)
        grams = code[new_gram]
        per_gram = np.concatenate((np.cumsum(new_doc)[new_gram] - 1, [len(docs)])).astype(np.int32)
        offsets = pa.array(per_gram)
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), pa.array(place))
        take = lambda i, kind: pa.array([p[i] for p in own], kind).take(pa.array(docs))
        names = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams.tolist()]
        columns = [pa.array([tier] * len(grams)), pa.array(names, pa.string()), lists(take(2, pa.int64())), lists(take(1, pa.string())), lists(take(3, pa.int32())), lists(places)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _GRAMS.split(", ")])


def gram_stats(docs: DataFrame) -> DataFrame:
    size = F.sum(F.greatest(F.lit(0), F.length(tx.fold_col(F.coalesce("text", F.lit("")))) - 2))
    return docs.groupBy("tier").agg(F.count(F.lit(1)).alias("n_docs"), size.alias("size"))


def write_grams(docs: DataFrame, path: str, buckets: int) -> None:
    """Trigram postings stay with their documents, as those of words do: a file has blocks of some texts, each sorted by gram."""
    spark = docs.sparkSession
    gram_stats(docs).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    chars = spark.read.parquet(f"{path}/stats").agg(F.sum("size")).first()[0] or 0
    dealt = docs.select("tier", "tenant_id", "seq", "text").repartition(_shards(chars, buckets), "tier", "seq")  # a few large files would be a few tasks
    grams_of(dealt).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")


def saved_grams(docs: DataFrame, path: str, buckets: int) -> Grams:
    write_grams(docs, path, buckets)
    spark = docs.sparkSession
    return Grams(spark.read.schema(_GRAMS).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def _stats(docs: DataFrame, postings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    tokens = postings.groupBy(*by).agg(F.sum("tf").alias("tokens"))
    counts = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(tokens, list(by), "left").select(*by, "n_docs", (F.coalesce("tokens", F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def build(docs: DataFrame, terms: Analyzer | Callable[[Column], Column] = PORTER, by: tuple[str, ...] = ("tier",)) -> Index:
    """Index documents with an analyzer (or a column of terms); ``by``, of tier and tenant_id, is the scope of the corpus figures.

    A document's length goes into its postings, so that scoring needs no join with a table of lengths.
    """
    analyzer = _analyzer(terms)
    raw = words_of(docs, analyzer)
    postings = raw if analyzer.stem is None else by_dictionary(raw, stemmed(raw.select("term"), analyzer))
    return Index(docs.drop("parts"), postings, _stats(docs, postings, by), analyzer, raw=raw, source=docs if "parts" in docs.columns else None)


#: Segments of a level that are merged to one of the next, and dead rows that a broadcast takes.
FAN_IN, SENT_DEAD = 4, 1_000_000
#: Keys of a batch that are looked up among the segments' documents by their hashes; more are joined.
LOOKED_UP = 5_000
_POSTINGS = "tier string, tenant_id string, seq long, term string, tf int, dl int, pos array<int>, forms " + _FORMS
_DOCS = "tier string, tenant_id string, seq long, category string, key string, text string, body string, ts string, hash long, dl int, size int"
_DEAD = "segment string, tier string, seq long, dl int, size int"


class Segments:
    """An index kept beside a store's logs, in segments that do not change.

    What came since the last time makes a new segment: documents, postings and trigrams, each sorted. A
    version that a later row replaces or deletes is noted as dead, and corpus figures are kept by adding and
    subtracting, so nothing is counted again. FAN_IN segments of a level become one of the next,
    without their dead rows. A manifest says which segments and dead rows count.
    """

    def __init__(self, store, analyzer: Analyzer = PORTER):
        self.store, self.spark, self.analyzer, self.root = store, store.spark, analyzer, f"{store.root}/_index/{analyzer.name}"
        self.manifest = Manifest(self.spark, f"{self.root}/state")

    def _state(self) -> tuple[int, dict]:
        n, state = self.manifest.read()
        return n, state or {"marks": {}, "segments": [], "dead": [], "n_dead": 0, "stats": {}, "words": [], "garbage": []}

    def _read(self, name: str, schema: str, state: dict | None = None) -> DataFrame:
        """Of all segments the rows of one kind, dead ones too."""
        state = self._state()[1] if state is None else state
        paths = [f"{self.root}/{s['id']}/{name}" for s in state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # each has its own folder of tiers
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _dead(self, state: dict) -> DataFrame | None:
        return self.spark.read.schema(_DEAD).parquet(*[f"{self.root}/{p}" for p in state["dead"]]) if state["dead"] else None

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        dead = self._dead(state)
        if dead is None:
            return rows
        names = dead.select("tier", "seq")
        return rows.join(F.broadcast(names) if state["n_dead"] <= SENT_DEAD else names, ["tier", "seq"], "left_anti")

    def _words(self, state: dict) -> DataFrame | None:
        if self.analyzer.stem is None or not state["words"]:
            return None
        return self.spark.read.schema("word string, terms array<string>").parquet(*[f"{self.root}/{p}" for p in state["words"]])

    def _new_rows(self, state: dict) -> tuple[DataFrame | None, dict]:
        """(documents and deletes of all tables that came since, marks): of a key the last row alone."""
        tables = {"entities": "entities", "state_documents": "state", "reference_documents": "reference", "journal_events": "journal"}
        found, marks = None, dict(state["marks"])
        for table, tier in tables.items():
            rows = self.store.scan(table).where(F.col("seq") > marks.get(table, -1))
            top = rows.agg(F.max("seq")).first()[0]
            if top is None:
                continue
            marks[table] = top
            rows = rows.where(F.col("seq") <= top)
            gone = F.lit(False) if table == "journal_events" else F.col("op") == "delete"
            keep = rows if table == "journal_events" else rows.withColumn("updated_at", F.col("ts"))
            docs = searchable(**{tier: keep}).join(rows.select("seq", gone.alias("gone")), "seq")
            found = docs if found is None else found.unionByName(docs)
        if found is None:
            return None, marks
        key = F.xxhash64("tier", "tenant_id", "category", "key")
        last = Window.partitionBy("tier", "tenant_id", "category", "key").orderBy(F.desc("seq"))
        return found.withColumn("hash", key).withColumn("at", F.row_number().over(last)).where("at = 1").drop("at"), marks

    def refresh(self) -> None:
        """Index the rows that came since the last time, then merge what is due."""
        n, state = self._state()
        new, marks = self._new_rows(state)
        if new is None:
            return
        name = f"segment-{uuid.uuid4().hex}"
        new.write.parquet(f"{self.root}/{name}/rows")
        new = self.spark.read.parquet(f"{self.root}/{name}/rows")
        live = new.where("not gone").drop("gone")
        raw = words_of(live, self.analyzer)
        state = state | {"marks": marks, "garbage": state["garbage"]}
        if self.analyzer.stem is not None:
            raw.write.parquet(f"{self.root}/{name}/raw")
            raw = self.spark.read.parquet(f"{self.root}/{name}/raw")
            known, words = self._words(state), raw.select("term").distinct().toDF("word")
            fresh = words if known is None else words.join(known.select("word"), "word", "left_anti")
            stemmed(fresh, self.analyzer).write.parquet(f"{self.root}/{name}/words")
            state = state | {"words": [*state["words"], f"{name}/words"]}
            raw = by_dictionary(raw, self._words(state))
        raw.sortWithinPartitions("term").write.partitionBy("tier").parquet(f"{self.root}/{name}/postings")
        postings = self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/{name}/postings")
        lengths = postings.groupBy("tier", "seq").agg(F.max("dl").alias("dl"))
        size = F.greatest(F.lit(0), F.length(tx.fold_col(F.coalesce("text", F.lit("")))) - 2)
        docs = live.drop("parts").join(lengths, ["tier", "seq"], "left").withColumn("dl", F.coalesce("dl", F.lit(0))).withColumn("size", size)
        names = [f.name for f in T.StructType.fromDDL(_DOCS)]
        docs.select(*names).repartitionByRange("hash").sortWithinPartitions("hash").write.partitionBy("tier").parquet(f"{self.root}/{name}/docs")
        grams_of(live).repartition("gram").sortWithinPartitions("gram").write.partitionBy("tier").parquet(f"{self.root}/{name}/grams")
        dead = self._replaced(new, state)
        if dead is not None:
            dead.write.parquet(f"{self.root}/{name}/dead")
            dead = self.spark.read.schema(_DEAD).parquet(f"{self.root}/{name}/dead")
        added = self._figures(self.spark.read.schema(_DOCS).parquet(f"{self.root}/{name}/docs"))
        gone = self._figures(dead) if dead is not None else {}
        stats = {t: [a + b - c for a, b, c in zip(state["stats"].get(t, [0] * 3), added.get(t, [0] * 3), gone.get(t, [0] * 3))] for t in {*state["stats"], *added}}
        n_dead = sum(f[0] for f in gone.values())
        state = state | {"stats": stats, "segments": [*state["segments"], {"id": name, "level": 0}], "n_dead": state["n_dead"] + n_dead}
        state = state | {"dead": [*state["dead"], f"{name}/dead"] if n_dead else state["dead"]}
        n = self.manifest.commit(n, state)
        for part in ("rows", "raw"):
            delete(self.spark, f"{self.root}/{name}/{part}")
        self._merge(n, state)

    @staticmethod
    def _figures(docs: DataFrame) -> dict[str, list[int]]:
        """By tier documents, tokens and characters: a row for each tier."""
        rows = docs.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"), F.sum("size").alias("size")).collect()
        return {r["tier"]: [r["n"], r["tokens"], r["size"]] for r in rows}

    def _replaced(self, new: DataFrame, state: dict) -> DataFrame | None:
        """Live rows of the segments whose keys have come again."""
        if not state["segments"]:
            return None
        keys = new.where("tier <> 'journal'").select("hash", "tier", "tenant_id", F.col("category").alias("c"), F.col("key").alias("k"))
        parts = None
        few = keys.count() <= LOOKED_UP
        hashes = [r["hash"] for r in keys.select("hash").distinct().collect()] if few else None  # a sorted column: pages without them are skipped
        for s in state["segments"]:
            docs = self.spark.read.schema(_DOCS).parquet(f"{self.root}/{s['id']}/docs")
            docs = docs.where(F.col("hash").isin(hashes)) if few else docs
            part = docs.select(F.lit(s["id"]).alias("segment"), "hash", "tier", "tenant_id", "category", "key", "seq", "dl", "size")
            parts = part if parts is None else parts.unionByName(part)
        same = F.col("category").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
        keys = F.broadcast(keys) if few else keys
        found = self._alive(parts, state).join(keys, ["hash", "tier", "tenant_id"]).where(same)
        return found.select(*[f.name for f in T.StructType.fromDDL(_DEAD)])

    def _merge(self, n: int, state: dict) -> None:
        """Merge the lowest level that has FAN_IN segments, and so on."""
        for old in state["garbage"]:  # folders of the merge before
            delete(self.spark, f"{self.root}/{old}")
        while True:
            levels = [s["level"] for s in state["segments"]]
            due = next((level for level in sorted(set(levels)) if levels.count(level) >= FAN_IN), None)
            if due is None:
                return
            parts = [s for s in state["segments"] if s["level"] == due]
            rest = [s for s in state["segments"] if s["level"] != due]
            own = {p["id"] for p in parts}
            name = f"segment-{uuid.uuid4().hex}"
            some = state | {"segments": parts}
            for kind, schema, key in (("postings", _POSTINGS, "term"), ("docs", _DOCS, "hash")):
                self._alive(self._read(kind, schema, some), state).repartitionByRange(key).sortWithinPartitions(key).write.partitionBy("tier").parquet(f"{self.root}/{name}/{kind}")
            self._merged_grams(some, state).repartitionByRange("gram").sortWithinPartitions("gram").write.partitionBy("tier").parquet(f"{self.root}/{name}/grams")
            now = state | {"segments": [*rest, {"id": name, "level": due + 1}], "garbage": [f"{p}/{kind}" for p in own for kind in ("postings", "docs", "grams")]}
            if len(state["words"]) > FAN_IN:  # the dictionary of all segments, as one
                self._words(state).repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{self.root}/{name}/words")
                now = now | {"words": [f"{name}/words"], "garbage": [*now["garbage"], *state["words"]]}
            dead = self._dead(state)
            if dead is not None:
                left = dead.where(~F.col("segment").isin(sorted(own)))
                count = left.count()
                if count:
                    left.write.parquet(f"{self.root}/{name}/dead")
                now = now | {"dead": [f"{name}/dead"] if count else [], "n_dead": count}
            state, n = now, self.manifest.commit(n, now)

    def _merged_grams(self, some: dict, state: dict) -> DataFrame:
        """Trigram rows of several segments without their dead documents; rows of one gram stay apart, in their order."""
        rows = self._read("grams", _GRAMS, some)
        dead = self._dead(state)
        if dead is None:
            return rows
        each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "tier", "gram", F.explode(F.arrays_zip("seqs", "tenants", "sizes", "places")).alias("d"))
        each = self._alive(each.withColumn("seq", F.col("d.seqs")), state)
        # a row has the documents of one block of texts
        made = each.groupBy("row", "tier", "gram").agg(F.collect_list("d").alias("d"))
        return made.select("tier", "gram", F.col("d.seqs").alias("seqs"), F.col("d.tenants").alias("tenants"), F.col("d.sizes").alias("sizes"), F.col("d.places").alias("places"))

    def indexed(self, tenant: str | None = None) -> DataFrame | None:
        """(tier, seq) of the live rows whose terms are there; None if nothing has been indexed or rows have come since."""
        state = self._state()[1]
        if not state["marks"] or (self.store.scan("entities").agg(F.max("seq")).first()[0] or 0) > state["marks"].get("entities", -1):
            return None
        rows = self._alive(self._read("postings", _POSTINGS, state), state)
        return (rows if tenant is None else rows.where(F.col("tenant_id") == tenant)).select("tier", "seq").distinct()

    def rebuild(self) -> None:
        """Forget all segments; the next refresh indexes every row."""
        n, state = self._state()
        old = [s["id"] for s in state["segments"]] + [p.partition("/")[0] for p in (*state["words"], *state["dead"])]
        self.manifest.commit(n, {"marks": {}, "segments": [], "dead": [], "n_dead": 0, "stats": {}, "words": [], "garbage": sorted({*old, *state["garbage"]})})

    def index(self) -> Index:
        """The live documents and their postings, brought up to date. Nothing is counted for it."""
        self.refresh()
        state = self._state()[1]
        docs = self._alive(self._read("docs", _DOCS, state), state).drop("hash", "dl", "size")
        postings = self._alive(self._read("postings", _POSTINGS, state), state)
        figures = [(t, n, tokens / n, size) for t, (n, tokens, size) in sorted(state["stats"].items()) if n]
        stats = small(self.spark, [f[:3] for f in figures], "tier string, n_docs long, avgdl double")
        grams = Grams(self._read("grams", _GRAMS, state), small(self.spark, [(t, n, size) for t, n, _, size in figures], "tier string, n_docs long, size long"), self._dead(state))
        return Index(docs, postings, stats, self.analyzer, grams)


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's occurrences in a document count, whatever the term."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bm25(tf: Column, dl: Column, n_docs: Column, avgdl: Column, df: Column) -> Column:
    """A term's share of the rank, lower is better; common terms count next to nothing, never against."""
    return -idf(n_docs, df) * weight(tf, dl, avgdl)


def folded(docs: DataFrame) -> DataFrame:
    """The documents with folded text, for substring search."""
    return docs.withColumn("folded", tx.fold_col(F.col("text")))

"""Lexical search: ranked word search over tiers, substring search, and the ladder that joins them.

A search is one plan, over all variants of all its queries at once: ranked rows are cut to the limit per
variant and tier, and the ladder's stages are rows with a stage number, joined so that a later stage never
moves or repeats what an earlier one has. Nothing is collected before the page.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import small
from . import shape
from .index import TIERS, Analyzer, Grams, Index, bm25, idf


def _variants(index: Index, variants: list[list[str]], prefix: bool = False) -> DataFrame:
    """(variant, slot, part, term, starts, slots, parts): a word of a query is a slot, and a phrase where the analyzer makes several terms of it."""
    rows = []
    for v, words in enumerate(variants):
        made = [t for w in words if (t := index.analyzer.query(w))]
        for i, terms in enumerate(made):
            rows += [(v, i, j, t, prefix and i == len(made) - 1 and j == len(terms) - 1, len(made), len(terms)) for j, t in enumerate(terms)]
    return small(index.docs.sparkSession, rows, "variant int, slot int, part int, word string, starts boolean, slots int, parts int")


def document_counts(index: Index, words: list[str], tiers: tuple[str, ...]) -> DataFrame:
    """(tier, term, df): of common terms from their blocks, of others from their few postings."""
    asked = lambda df: df.where(F.col("tier").isin(*tiers) & F.col("term").isin(words))
    common = asked(index.blocks).groupBy("tier", "term").agg(F.sum("n").alias("df"))
    rare = asked(index.postings).join(F.broadcast(common), ["tier", "term"], "left_anti").groupBy("tier", "term").agg(F.count(F.lit(1)).alias("df"))
    return common.unionByName(rare)


#: Documents from which on word search prunes by default.
PRUNE_FROM = 1_000_000
#: Blocks of each variant and tier that are scored first, to know what the others have to beat.
FIRST_BLOCKS = 8
#: Blocks that are kept by a broadcast of their names; more of them are joined by a shuffle.
SENT_BLOCKS = 100_000


def best_blocks(index: Index, variants: list[list[str]], limit: int, tiers: tuple[str, ...], tenant: str | None) -> DataFrame | None:
    """(variant, tier, block): the blocks of documents that can hold one of the best ``limit``; None if nothing is saved by it.

    A block's bound is the sum of its terms' largest shares. The
    blocks of the best bounds are scored first. The rank that their documents reach is what any other
    block has to reach as well, at equal ranks too, since the smaller number goes first. Only variants all of
    whose words are common have bounds; the others' postings are few, and read.
    """
    spark = index.docs.sparkSession
    made = [[t for x in ws for t in index.analyzer.query(x)] for ws in variants]  # a word asked for twice counts twice
    rows = [(v, i, t, len(ts)) for v, ts in enumerate(made) for i, t in enumerate(ts)]
    if not rows:
        return None
    words = sorted({t for ts in made for t in ts})
    asked = F.broadcast(small(spark, rows, "variant int, slot int, term string, many int"))
    held = index.blocks.where(F.col("tier").isin(*tiers) & F.col("term").isin(words))
    df = F.broadcast(held.groupBy("tier", "term").agg(F.sum("n").alias("df")))  # a row for each word and tier
    share = bm25(F.col("tf"), F.col("dl"), F.col("n_docs"), F.col("avgdl"), F.col("df"))
    bounds = held.join(df, ["tier", "term"]).join(F.broadcast(index.stats), "tier").join(asked, "term")
    most_of = -idf(F.col("n_docs"), F.col("df")) * F.col("best")
    bounds = bounds.groupBy("variant", "many", "tier", "block").agg((F.sum(most_of) * (1 + 1e-9)).alias("bound"), F.count(F.lit(1)).alias("held"))
    bounds = bounds.where("held = many")
    order = Window.partitionBy("variant", "tier").orderBy("bound", "block")
    # which variants and tiers have bounds at all, and their best blocks: bounded by the query
    first = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= FIRST_BLOCKS).select("variant", "tier", "block").collect()
    if not first:
        return None
    start = F.broadcast(small(spark, [tuple(r) for r in first], "variant int, tier string, block long"))
    few = [r["block"] for r in first]
    seen = held_postings(index, words, tiers).where(F.col("block").isin(few)).join(asked, "term").join(start, ["variant", "tier", "block"])
    seen = seen if tenant is None else seen.where(F.col("tenant_id") == tenant)
    scored = seen.join(df, ["tier", "term"]).join(F.broadcast(index.stats), "tier")
    ranks = scored.groupBy("variant", "many", "tier", "seq").agg(F.sum(share).alias("rank"), F.count(F.lit(1)).alias("held")).where("held = many")
    most = F.when(F.col("tier") == "journal", max(1, limit // 4)).otherwise(limit)
    last = ranks.withColumn("at", F.row_number().over(Window.partitionBy("variant", "tier").orderBy("rank"))).where(F.col("at") == F.least(most, F.lit(limit)))
    reached = F.broadcast(last.select("variant", "tier", (F.col("rank") * (1 - 1e-9)).alias("reached")))
    kept = bounds.join(reached, ["variant", "tier"], "left").where(F.col("bound") <= F.coalesce("reached", F.lit(0.0)))
    return kept.select("variant", "tier", "block")


def held_postings(index: Index, words: list[str], tiers: tuple[str, ...]) -> DataFrame:
    return index.postings.where(F.col("tier").isin(*tiers) & F.col("term").isin(words))


def _matched(index: Index, asked: DataFrame, words: list[str], prefix: bool, phrases: bool, tiers: tuple[str, ...], kept: DataFrame | None = None) -> DataFrame:
    """(variant, slot, slots, tier, tenant_id, seq, dl, tf): how often a document has a query's word or phrase.

    ``kept`` names the blocks to read of the variants and tiers that it has; the others are read whole.
    """
    postings = index.postings.where(F.col("tier").isin(*tiers))
    own = ["variant", "slot", "slots", "tier", "tenant_id", "seq", "dl"]
    if prefix:
        found = postings.join(asked, F.when(F.col("starts"), F.startswith("term", F.col("word"))).otherwise(F.col("term") == F.col("word")))
    else:
        found = postings.where(F.col("term").isin(words)).join(asked, F.col("term") == F.col("word"))
    if kept is not None:
        names = kept.withColumn("in", F.lit(True))
        n = kept.count()
        held = F.broadcast(kept.select("variant", "tier").distinct().withColumn("cut", F.lit(True)))  # at most a row for each variant and tier
        found = found.join(F.broadcast(names) if n <= SENT_BLOCKS else names, ["variant", "tier", "block"], "left").join(held, ["variant", "tier"], "left")
        found = found.where(F.col("cut").isNull() | F.col("in"))
    single = found.where("parts = 1") if phrases else found
    single = single.groupBy(*own).agg(F.sum("tf").alias("tf")) if prefix else single.select(*own, "tf")
    if not phrases:
        return single
    # every place names the phrase's start; a start that all parts name is one
    starts = F.explode(F.transform("pos", lambda p: p - F.col("part"))).alias("start")
    named = found.where("parts > 1").select(*own, "part", "parts", starts).groupBy(*own, "parts", "start").agg(F.count_distinct("part").alias("n"))
    return single.unionByName(named.where("n = parts").groupBy(*own).agg(F.count(F.lit(1)).alias("tf")).select(*own, "tf"))


def rank_words(index: Index, variants: list[list[str]], limit: int | None, prefix: bool = False, tiers: Iterable[str] = TIERS, tenant: str | None = None, where: Column | None = None, any_word: bool = False, prune: bool | None = None) -> DataFrame:
    """(variant, tier, seq, tenant_id, rank, pos): per variant and tier the best documents holding all its words.

    Words are analyzed as documents are; one that becomes several terms is a phrase, one that becomes
    none is left out. Each tier gives at most ``limit`` documents, the journal a quarter of it; with
    None every match comes back, unnumbered (without pos). Corpus figures are those of all tenants;
    the tenant filters afterwards. ``any_word`` asks for one word instead of all. ``prune`` leaves out blocks of
    documents that cannot reach the limit, which takes two small jobs first; by default where the index is large. Results are the same.
    """
    tiers = tuple(tiers) or TIERS
    unknown = set(tiers) - set(TIERS)
    if unknown:
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    asked = F.broadcast(_variants(index, variants, prefix))  # as many rows as the query has words
    terms = [index.analyzer.query(w) for ws in variants for w in ws]
    words = sorted({t for ts in terms for t in ts})
    phrases = any(len(ts) > 1 for ts in terms)
    kept = None
    can = index.blocks is not None and limit is not None and limit > 0 and not prefix and not phrases and not any_word and where is None
    if can and (prune or prune is None and index.documents() >= PRUNE_FROM):
        kept = best_blocks(index, variants, limit, tiers, tenant)
    matched = _matched(index, asked, words, prefix, phrases, tiers, kept)
    if kept is None:
        df = matched.groupBy("variant", "slot", "tier").agg(F.count(F.lit(1)).alias("df"))
    else:
        df = document_counts(index, words, tiers).join(asked.select("variant", "slot", "word"), F.col("term") == F.col("word")).select("variant", "slot", "tier", "df")
    scored = matched.join(F.broadcast(df), ["variant", "slot", "tier"]).join(F.broadcast(index.stats), "tier")
    share = bm25(F.col("tf"), F.col("dl"), F.col("n_docs"), F.col("avgdl"), F.col("df"))
    hits = scored.groupBy("variant", "slots", "tier", "tenant_id", "seq").agg(F.sum(share).alias("rank"), F.count_distinct("slot").alias("held"))
    hits = hits.where(F.col("held") >= (F.lit(1) if any_word else F.col("slots")))
    if tenant is not None:
        hits = hits.where(F.col("tenant_id") == tenant)
    if where is not None:
        hits = hits.join(index.docs.where(where).select("tier", "seq"), ["tier", "seq"], "left_semi")
    if limit is None:
        return hits.select("variant", "tier", "seq", "tenant_id", "rank")
    most = F.when(F.col("tier") == "journal", max(1, limit // 4)).otherwise(limit)
    order = Window.partitionBy("variant", "tier").orderBy("rank", "seq")
    return hits.withColumn("pos", F.row_number().over(order)).where((F.col("pos") <= limit) & (F.col("pos") <= most)).select("variant", "tier", "seq", "tenant_id", "rank", "pos")


def rank_phrase(index: Index, phrase: str, limit: int | None, **options) -> DataFrame:
    """``rank_words`` for one phrase: its terms side by side, in one column of a document."""
    terms = [t for w in tx.query_tokens(phrase) for t in index.analyzer.query(w)]
    whole = Index(index.docs, index.postings, index.stats, Analyzer("phrase", lambda w: terms))
    return rank_words(whole, [[phrase]] if terms else [], limit, **options)


def _cover(part: str) -> list[tuple[int, str]]:
    """(offset, gram): trigrams that together are the part, as few as it takes."""
    at = [*range(0, len(part) - 2, 3), len(part) - 3]
    return [(i, part[i : i + 3]) for i in sorted(set(at))]


def _occurrences(grams: Grams, parts: list[str], tiers: tuple[str, ...]) -> DataFrame:
    """(part, tier, seq, tenant_id, size, tf): the documents that have a part, and at how many places, from trigram postings.

    Places of a part's trigrams, moved back by their offsets, have the part's places in common. Parts of fewer than three characters
    are prefixes of the trigrams that begin where they do. Texts are not read.
    """
    spark = grams.postings.sparkSession
    pieces = [(i, o, g, len(_cover(p))) for i, p in enumerate(parts) if len(p) >= 3 for o, g in _cover(p)]
    rows = grams.postings.where(F.col("tier").isin(*tiers))
    flat = lambda df: df.select("part", "offset", "many", "tier", F.explode(F.arrays_zip("seqs", "tenants", "sizes", "places")).alias("d"))
    found = []
    if pieces:
        asked = F.broadcast(small(spark, pieces, "part int, offset int, gram string, many int"))
        found.append(flat(rows.where(F.col("gram").isin(sorted({g for _, _, g, _ in pieces}))).join(asked, "gram")))
    for i, p in enumerate(parts):
        if len(p) < 3:
            found.append(flat(rows.where(F.startswith("gram", F.lit(p))).select("*", F.lit(i).alias("part"), F.lit(0).alias("offset"), F.lit(1).alias("many"))))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    doc = ["part", "many", "tier", F.col("d.seqs").alias("seq"), F.col("d.tenants").alias("tenant_id"), F.col("d.sizes").alias("size")]
    if grams.dead is not None:
        every = every.withColumn("seq", F.col("d.seqs")).join(grams.dead.select("tier", "seq"), ["tier", "seq"], "left_anti").drop("seq")
    moved = every.select(*doc, F.col("offset"), F.transform("d.places", lambda x: x - F.col("offset")).alias("at"))
    own = ["part", "many", "tier", "seq", "tenant_id", "size"]
    # several rows of one gram and document are parts of a long text, or grams with one beginning
    by_gram = moved.groupBy(*own, "offset").agg(F.flatten(F.collect_list("at")).alias("at"))
    by_doc = by_gram.groupBy(*own).agg(F.collect_list("at").alias("ats")).where(F.size("ats") == F.col("many"))
    common = F.aggregate(F.slice("ats", 2, 1 << 30), F.col("ats")[0], lambda acc, x: F.array_intersect(acc, x))
    return by_doc.select("part", "tier", "seq", "tenant_id", "size", F.size(common).alias("tf")).where("tf > 0")


def _asked_parts(queries: list[str]) -> list[tuple[int, list[str], list[str]]]:
    """Of each query its number, the parts that rank, and those that only filter."""
    asked = []
    for v, query in enumerate(queries):
        parts = [p for p in "".join(c if c.isalnum() or c == "_" else " " for c in tx.fold(query)).split()]
        ranked = list(dict.fromkeys(p for p in parts if len(p) >= 3))
        also = list(dict.fromkeys(p for p in parts if len(p) < 3 and not p.isascii()))
        if ranked or also:
            asked.append((v, ranked, also))
    return asked


def _gram_hits(grams: Grams, asked: list[tuple[int, list[str], list[str]]], tiers: tuple[str, ...], tenant: str | None) -> DataFrame:
    """(variant, tier, seq, rank) of every document that holds all parts of a query."""
    spark = grams.postings.sparkSession
    parts = list(dict.fromkeys(p for _, ranked, also in asked for p in ranked + also))
    held = _occurrences(grams, parts, tiers)
    df = held.groupBy("part").agg(F.count(F.lit(1)).alias("df"))
    figures = grams.stats.where(F.col("tier").isin(*tiers)).agg(F.sum("n_docs").alias("n_docs"), (F.sum("size") / F.sum("n_docs")).alias("avgdl"))  # one row
    wanted = [(v, parts.index(p), p in ranked, len(ranked) + len(also)) for v, ranked, also in asked for p in ranked + also]
    of = F.broadcast(small(spark, wanted, "variant int, part int, ranks boolean, parts int"))
    hits = held.join(F.broadcast(df), "part").crossJoin(F.broadcast(figures)).join(of, "part")
    hits = hits if tenant is None else hits.where(F.col("tenant_id") == tenant)
    share = bm25(F.col("tf"), F.col("size") - 2, F.col("n_docs"), F.col("avgdl"), F.col("df"))
    out = hits.groupBy("variant", "parts", "tier", "seq").agg(F.sum(F.when(F.col("ranks"), share).otherwise(0.0)).alias("rank"), F.count(F.lit(1)).alias("held"))
    return out.where("held = parts").select("variant", "tier", "seq", "rank")


def rank_substrings(folded: DataFrame | Grams, queries: list[str], limit: int | None, tiers: Iterable[str] = TIERS, tenant: str | None = None) -> DataFrame:
    """(variant, tier, seq, rank, pos): documents whose folded text holds all parts of a folded query.

    Parts of three characters and more are ranked by trigram BM25 (occurrences of the part, length in
    trigrams); shorter parts only filter where they are not ASCII, and are dropped where they are.
    With a limit of None every match comes back, unnumbered (without pos). Trigram postings answer without
    reading a text; folded texts are scanned twice.
    """
    saved = isinstance(folded, Grams)
    spark = (folded.postings if saved else folded).sparkSession
    tiers = tuple(tiers) or TIERS
    asked = _asked_parts(queries)
    if not asked:
        return small(spark, [], "variant int, tier string, seq long, rank double" + (", pos int" if limit is not None else ""))
    out = _gram_hits(folded, asked, tiers, tenant) if saved else _scanned(folded.where(F.col("tier").isin(*tiers)), asked, tenant)
    if limit is None:
        return out
    fetched = Window.partitionBy("variant").orderBy("rank", "tier", "seq")
    out = out.withColumn("at", F.row_number().over(fetched)).where(F.col("at") <= 4 * limit).drop("at")
    # the journal is held to a quarter of the limit, then the whole to the limit
    own = Window.partitionBy("variant", "tier").orderBy("rank", "seq")
    kept = out.withColumn("own", F.row_number().over(own)).where((F.col("tier") != "journal") | (F.col("own") <= max(1, limit // 4)))
    order = Window.partitionBy("variant").orderBy("rank", "tier", "seq")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("variant", "tier", "seq", "rank", "pos")


def _scanned(docs: DataFrame, asked: list[tuple[int, list[str], list[str]]], tenant: str | None) -> DataFrame:
    """``_gram_hits`` from the folded texts themselves: one pass for the figures of all queries and one for the hits."""
    every = list(dict.fromkeys(p for _, ranked, _ in asked for p in ranked))
    figures = docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest(F.lit(0), F.length("folded") - 2)).alias("avgdl"),
        *[F.sum(F.contains("folded", F.lit(p)).cast("long")).alias(f"df{i}") for i, p in enumerate(every)],
    )
    part = docs if tenant is None else docs.where(F.col("tenant_id") == tenant)
    found = []
    for v, ranked, also in asked:
        cond = F.lit(True)
        for p in ranked + also:
            cond = cond & F.contains("folded", F.lit(p))
        # occurrences may overlap: places at which the part (letters, digits and underscores) begins
        tf = lambda p: F.regexp_count("folded", F.lit(f"(?={p})"))
        rank = sum((bm25(tf(p), F.length("folded") - 2, F.col("n_docs"), F.col("avgdl"), F.col(f"df{every.index(p)}")) for p in ranked), F.lit(0.0))
        found.append(F.when(cond, F.struct(F.lit(v).alias("variant"), rank.alias("rank"))))
    hits = part.crossJoin(F.broadcast(figures))  # one row of figures
    return hits.select("tier", "seq", F.explode(F.array_compact(F.array(*found))).alias("h")).select("h.variant", "tier", "seq", "h.rank")


def _shown(body: Column, *more: Column) -> Column:
    """Body, key and category as normalised words."""
    return tx.normalized_col(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (body, *more)]))


# the ladder

_HIT = ["q", "stage", "pos", "tier", "seq", "category", "key", "ts", "rank", "part"]
#: What a hit is: rows of one identity are one hit, wherever they were found.
IDENTITY = ["q", "tier", "category", "key"]
#: Stages of a ladder's result, in order.
HEAD, SUBSTRINGS, STEMMED, ONE_STEM, HELD_BACK = range(5)


#: Candidates of the latest searches, which their plans read several times; as few rows as limits allow. One that is let go is made again.
_KEPT: deque[DataFrame] = deque()
MOST_KEPT = 24


#: Queries whose candidates lie in one partition: what is done with so few rows then needs no exchange.
TOGETHER = 100


def _kept(df: DataFrame, queries: int) -> DataFrame:
    df = df.repartition(1) if queries <= TOGETHER else df
    _KEPT.append(df.persist())
    while len(_KEPT) > MOST_KEPT:
        old = _KEPT.popleft()
        context = old.sparkSession.sparkContext._jsc
        if context is not None and not context.sc().isStopped():
            old.unpersist()
    return df.coalesce(1) if queries <= TOGETHER else df


def _who() -> Column:
    return F.to_json(F.struct("tier", "category", "key"))


def _tier_order() -> Column:
    return F.coalesce(*[F.when(F.col("tier") == t, F.lit(i)) for i, t in enumerate(TIERS)])


def _documents(index: Index, hits: DataFrame, *more: str) -> DataFrame:
    """Hits (tier, seq, ...), as many as limits allow, with what names their documents."""
    return index.docs.select("tier", "seq", "category", "key", "ts", *more).join(F.broadcast(hits), ["tier", "seq"])


def _near(words: dict[int, list[str]]) -> Column:
    """How near the words of a row's variant are in its document's body, key and category."""
    out, text = F.lit(0), _shown(F.col("body"), F.col("key"), F.col("category"))
    for v, ws in words.items():
        if len(ws) >= 2:
            out = F.when(F.col("variant") == v, tx.proximity_col(ws, text)).otherwise(out)
    return out


def nearness(index: Index, variants: dict[int, list[str]], tiers: Iterable[str] = TIERS, hits: DataFrame | None = None) -> DataFrame:
    """(variant, tier, seq, near) of documents with all words of a variant, from the places in their postings: no text is read.

    0: the words are a phrase inside one column. 1: the shortest run of places that has them all is short. 2: else. Words
    count as they stand, not by their stems, and are told apart as the analyzer does. Places go through the columns in
    the order in which they are indexed, with one between two columns. A variant of fewer than two words has no rows. ``hits``
    (variant, tier, seq), few enough to be sent to every task, are the only documents looked at, if given.
    """
    rows = []
    for v, ws in variants.items():
        plain = [p for w in ws for p in index.analyzer.words(w)]
        if len(ws) < 2 or not plain:
            continue
        own = list(dict.fromkeys(plain))
        rows += [(v, i, w, index.analyzer.query(w)[0], [k for k, p in enumerate(plain) if p == w], len(own), len(plain)) for i, w in enumerate(own)]
    spark = index.docs.sparkSession
    if not rows:
        return small(spark, [], "variant int, tier string, seq long, near int")
    asked = F.broadcast(small(spark, rows, "variant int, word_id int, asked string, term string, offsets array<int>, many int, length int"))
    found = held_postings(index, sorted({r[3] for r in rows}), tuple(tiers) or TIERS).join(asked, "term")
    if hits is not None:
        found = found.join(F.broadcast(hits.select("variant", "tier", "seq")), ["variant", "tier", "seq"])
    places = F.when(F.col("asked") == F.col("term"), F.col("pos")).otherwise(F.array().cast("array<int>"))
    if "forms" in index.postings.columns:
        held = F.flatten(F.transform(F.filter("forms", lambda f: f["word"] == F.col("asked")), lambda f: f["pos"]))
        places = F.when(F.col("forms").isNull(), places).otherwise(held)
    each = found.select("variant", "tier", "seq", "many", "length", F.struct("word_id", "offsets", places.alias("places")).alias("w"))
    docs = each.groupBy("variant", "tier", "seq", "many", "length").agg(F.collect_list("w").alias("w")).where(F.size("w") == F.col("many"))
    starts = F.flatten(F.flatten(F.transform("w", lambda w: F.transform(w["offsets"], lambda o: F.transform(w["places"], lambda p: p - o)))))
    # a start that every word of the phrase names is one: per word and offset the starts are distinct
    docs = docs.withColumn("starts", F.array_sort(starts))
    phrase = F.exists(F.transform("starts", lambda s, i: s == F.get("starts", i + F.col("length") - 1)), lambda same: same)
    merged = F.array_sort(F.flatten(F.transform("w", lambda w: F.transform(w["places"], lambda p: F.struct(p.alias("at"), w["word_id"].alias("id"))))))
    never = F.lit(1 << 30)
    start = F.struct(never.alias("best"), F.array_repeat(F.lit(-1), F.col("many")).alias("seen"))

    def step(acc: Column, place: Column) -> Column:
        seen = F.transform(acc["seen"], lambda x, i: F.when(i == place["id"], place["at"]).otherwise(x))
        first = F.array_min(seen)
        return F.struct(F.when(first >= 0, F.least(acc["best"], place["at"] - first + 1)).otherwise(acc["best"]).alias("best"), seen.alias("seen"))

    span = F.aggregate(merged, start, step, lambda acc: acc["best"])
    near = F.when(phrase, 0).when(span <= F.col("length") + tx.PROXIMITY_SLACK, 1).otherwise(2)
    return docs.select("variant", "tier", "seq", near.alias("near"))


def _with_near(index: Index, ranked: DataFrame, words: dict[int, list[str]], tiers: Iterable[str]) -> DataFrame:
    """Ranked hits (variant, tier, seq, ...), as many as limits allow, with their nearness and what names their documents."""
    if all(len(ws) < 2 for ws in words.values()):
        return _documents(index, ranked).withColumn("near", F.lit(0))
    if index.analyzer.words is None:  # such an analyzer has no words of its own to compare
        return _documents(index, ranked, "body").withColumn("near", _near(words))
    ranked = _kept(ranked, len(words))
    near = F.broadcast(nearness(index, words, tiers, ranked))
    most = F.when(F.col("variant").isin([v for v, ws in words.items() if len(ws) >= 2]), 2).otherwise(0)
    return _documents(index, ranked.join(near, ["variant", "tier", "seq"], "left").withColumn("near", F.coalesce("near", most)))


def _heads(index: Index, queries: list[str], cap: int, prefix: bool, tiers: Iterable[str], tenant: str | None) -> DataFrame:
    """Of each query the hits of its first form that has any, near words first; of a full head by one word the last quarter as HELD_BACK."""
    spark = index.docs.sparkSession
    forms = []  # (query, place among its forms, words)
    for q, query in enumerate(queries):
        strict = [w.lower() for w in tx.query_tokens(query, prefix)]
        forms += [(q, i, ws) for i, ws in enumerate(([strict] if strict else []) + ([] if prefix else tx.relaxed_queries(query)))]
    if not forms or not cap:
        return small(spark, [], "q int, stage int, pos int, tier string, seq long, category string, key string, ts string, rank double, part boolean")
    of = F.broadcast(small(spark, [(v, q, i, i > 0 and len(ws) == 1) for v, (q, i, ws) in enumerate(forms)], "variant int, q int, form int, single boolean"))
    ranked = rank_words(index, [ws for _, _, ws in forms], cap, prefix, tiers, tenant).drop("pos", "tenant_id")
    rows = _with_near(index, ranked, {v: ws for v, (_, _, ws) in enumerate(forms)}, tiers).join(of, "variant")
    every = Window.partitionBy("q")
    rows = rows.withColumn("first", F.min("form").over(every)).where("form = first")
    rows = rows.withColumn("pos", F.row_number().over(every.orderBy("near", "rank", _tier_order(), "seq"))).withColumn("n", F.count(F.lit(1)).over(every)).where(F.col("pos") <= cap)
    back = F.col("single") & (F.lit(cap) >= 2) & (F.col("n") >= cap) & (F.col("pos") > cap - max(1, cap // 4))
    return rows.withColumn("stage", F.when(back, HELD_BACK).otherwise(HEAD)).withColumn("part", F.lit(False)).select(*_HIT)


def _page(rows: DataFrame, cap: int) -> DataFrame:
    """Stages joined, each hit where it was found first, to ``cap`` hits of a query, numbered anew."""
    order = Window.partitionBy("q").orderBy("stage", "at")
    one = shape.appended(rows, IDENTITY).withColumnRenamed("pos", "at")
    return one.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap).select(*_HIT)


def ladder(index: Index, folded: DataFrame | Grams, queries: list[str], limit: int = 20, prefix: bool = False, tiers: Iterable[str] = TIERS, tenant: str | None = None) -> DataFrame:
    """(q, stage, pos, tier, seq, category, key, ts, rank, part): the hits of several queries, all in one plan.

    Head: the strict search, or the first weaker form that finds anything. Then, while there is
    room: substring hits; if some word's stem is in no text so far, substring hits of the stemmed
    query, or else of the one such stem with the fewest hits (longest first) that adds any.
    A head that one single word filled gives back a quarter of its places for this, and takes
    back what is left of them. A hit's identity is its tier, category and key. ``part`` marks substring hits.
    """
    cap = tx.clamp_limit(limit)
    heads = _kept(_heads(index, queries, cap, prefix, tiers, tenant), len(queries))
    spark = index.docs.sparkSession
    probes, stems = [], []  # (query, kind, stem), its text; (query, stem, its folded form, its place)
    for q, query in enumerate(queries):
        words = tx.query_tokens(query)
        cut = [tx.stem(w) for w in words]
        own = [s for s, w in {tx.stem(w): w for w in words}.items() if s != w]
        probes += [((q, SUBSTRINGS, None), query)] + [((q, STEMMED, None), " ".join(cut))] * (cut != words) + [((q, ONE_STEM, s), s) for s in own]
        stems += [(q, s, tx.fold(s), i) for i, s in enumerate(own)]
    if prefix or not cap or not probes:
        return _page(heads, max(1, cap))
    asked = F.broadcast(small(spark, [(v, *p) for v, (p, _) in enumerate(probes)], "variant int, q int, stage int, stem string"))
    found = rank_substrings(folded, [text for _, text in probes], cap, tiers, tenant)
    found = _documents(index, found.select("variant", "tier", "seq", "rank", "pos")).join(asked, "variant").withColumn("part", F.lit(True))
    found = _kept(found, len(queries))
    hits = lambda stage: found.where(F.col("stage") == stage)
    sure = heads.where(F.col("stage") == HEAD).unionByName(hits(SUBSTRINGS).select(*_HIT))
    if not stems:
        return _page(sure.unionByName(heads.where(F.col("stage") == HELD_BACK)), cap)
    before = _kept(_page(sure, cap), len(queries))
    # stems of queries with room that no text so far has
    full = before.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("q")
    shown = tx.fold_col(F.substring(_shown(F.col("key"), F.col("category"), F.col("body")), 1, tx.GATE_CHARS))
    texts = index.docs.join(F.broadcast(before.select("q", "tier", "seq")), ["tier", "seq"]).select("q", shown.alias("text"))
    every = F.broadcast(small(spark, stems, "q int, stem string, folded string, place int"))
    held = texts.join(every, "q").where(F.contains("text", F.col("folded"))).select("q", "stem").distinct()
    open_stems = every.join(full, "q", "left_anti").join(held, ["q", "stem"], "left_anti")
    seen = before.select("q", _who().alias("who"))
    fresh = lambda rows: rows.withColumn("who", _who()).join(seen, ["q", "who"], "left_anti").drop("who")
    stemmed = fresh(hits(STEMMED).join(open_stems.select("q").distinct(), "q", "left_semi"))
    # of queries that this adds nothing to the one stem whose hits are fewest
    single = hits(ONE_STEM).join(open_stems.select("q", "stem", "place"), ["q", "stem"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("q", "stem")))
    single = fresh(single).join(stemmed.select("q").distinct(), "q", "left_anti")
    best = F.min(F.struct("n", -F.length("stem"), "place")).over(Window.partitionBy("q"))
    single = single.withColumn("best", best).where(F.col("place") == F.col("best.place"))
    return _page(heads.unionByName(hits(SUBSTRINGS).select(*_HIT)).unionByName(stemmed.select(*_HIT)).unionByName(single.select(*_HIT)), cap)


def page(index: Index, hits: DataFrame, words: list[str] = ()) -> DataFrame:
    """(pos, tier, key, category, body, rank, ts, snippet): the hits of one query (pos, tier, seq, rank, part) with their contents."""
    wanted = sorted({t for w in words for t in index.analyzer.query(w)})
    analyze = index.analyzer.query
    cut = F.udf(lambda text: snippet(text, wanted, terms=analyze), "string")  # on the rows of a page alone
    text = F.coalesce("body", "text")
    rows = _documents(index, hits.select("pos", "tier", "seq", "rank", "part"), "body", "text")
    shown = F.when(F.col("part"), F.substring(tx.fold_col(text), 1, SHORT_SNIPPET)).otherwise(cut(F.when(~F.col("part"), text)))
    return rows.select("pos", "tier", "key", "category", "body", "rank", "ts", shown.alias("snippet")).orderBy("pos")


def search(index: Index, folded: DataFrame | Grams, query: str, **options) -> DataFrame:
    """The ladder for one query, as a table (pos, tier, key, category, body, rank, ts, snippet)."""
    return page(index, ladder(index, folded, [query], **options), tx.query_tokens(query))


def nothing(spark: SparkSession) -> DataFrame:
    return small(spark, [], "pos int, tier string, key string, category string, body string, rank double, ts string, snippet string")


def search_entities(index: Index, query: str, limit: int = 20, prefix: bool = False, category: str | None = None, tenant: str | None = None) -> DataFrame:
    """The strict search over entities alone, of one category if given; near words first."""
    words = [w.lower() for w in tx.query_tokens(query, prefix)]
    cap = tx.clamp_limit(limit)
    if not words or not cap:
        return nothing(index.docs.sparkSession)
    ranked = rank_words(index, [words], cap, prefix, ("entity",), tenant, F.col("category") == category if category else None)
    rows = _with_near(index, ranked.select("variant", "tier", "seq", "rank"), {0: words}, ("entity",))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("variant").orderBy("near", "rank", "seq"))).withColumn("part", F.lit(False))
    return page(index, rows, words)


#: Characters of a substring hit's snippet.
SHORT_SNIPPET = 120


def snippet(text: str | None, words: list[str], width: int = 12, terms: Callable[[str], list[str]] = lambda p: tx.normalized(p).split()) -> str:
    """A window of words around the first match, matches in brackets; ``terms`` makes of a word what is compared."""
    parts = (text or "").split()
    wanted = {w.lower() for w in words}
    match = [i for i, p in enumerate(parts) if set(terms(p)) & wanted]
    start = 0 if not match or match[0] < width else min(match[0], max(0, len(parts) - width))
    shown = [f"[{p}]" if i in set(match) else p for i, p in enumerate(parts)][start : start + width]
    return ("..." if start else "") + " ".join(shown) + ("..." if start + width < len(parts) else "")


# the default agent path: several linked records


#: Words that a record search leaves out, words that ask for a final state, and what tells drafts from results.
SKIPPED = frozenset("the a an and or but is are was were be to of in on at for with this that final current by".split())
FINAL_WORDS = frozenset("final resolved approved published closed sent emailed decision finalized".split())
FINAL_TEXT = r"(?<!not )\b(final|finaliz\w*|resolved|approved|published|closed|sent|emailed|decision|signed|bound)\b"
DRAFT_TEXT = r"\b(draft|triage|forecast|planning|proposed|tentative|pending|agenda|scheduled|rehearsal|sample|option|wip|follow-?up)\b|work in progress"
BAND, FLOOR, HIGH, PER_WORD, FAN_OUT = 2.0, 0.45, 0.65, 200, 24
#: Words that carry no content of their own, by language; one that nothing matches is left out of a record search instead of
#: emptying it. Articles, pronouns, prepositions and forms of to be and to have; callers pass their own set for more.
_LITTLE = {
    "de": "der das den dem ein eine einen einem einer ich du er sie es wir ihr ist sind waren haben hatte und oder aber nicht von zu zum zur mit bei auf aus für im wann wer wie wo",
    "es": "el la los las un una unos unas yo tú él ella nosotros ellos es han y o pero no de del a al en por para sobre cuándo quién cómo dónde qué",
    "fr": "le la les un une des je tu il elle nous vous ils est sont était a ont et ou mais ne pas de du au aux avec dans en pour par sur quand qui comment où que quoi",
    "it": "il lo la gli le un uno una io tu lui lei noi voi è sono ha hanno e o ma non di del da in su per quando chi come dove che cosa",
    "pl": "ja ty on ona my wy oni jest są był była było ma mają i lub ale nie w we na z ze do od po za o u dla kiedy kto jak gdzie co czy się ten ta te",
}
#: Words of these lists that mean something in another language that the library knows, such as the month May or a can: never dropped.
CONTENT = frozenset("war die hat con son era ten can may might will".split())
FUNCTION_WORDS = (tx.STOPWORDS | frozenset(w for words in _LITTLE.values() for w in words.split())) - CONTENT


def record_tokens(query: str) -> list[str]:
    out = []
    for t in "".join(c if c.isalnum() or c == "_" else " " for c in query).split():
        low = t.lower()
        if t.isascii():
            if len(low) > 2 and low not in SKIPPED:
                out.append(low)
        else:
            out.append(low if len(low) == len(t) else t)
    uniq = list(dict.fromkeys(out))
    if len(uniq) > FAN_OUT:
        uniq = ([t for t in uniq if t in FINAL_WORDS] + sorted((t for t in uniq if t not in FINAL_WORDS), key=len, reverse=True))[:FAN_OUT]
    return uniq


def search_records(index: Index, folded: DataFrame | Grams, query: str, limit: int = 10, tenant: str | None = None, function_words: frozenset[str] = FUNCTION_WORDS, corpus: int | None = None) -> DataFrame:
    """``search_records_many`` for one query, as a table (pos, tier, key, category, body, rank, ts, snippet)."""
    found = search_records_many(index, folded, [query], limit, tenant, function_words, corpus)
    return page(index, found, record_tokens(query))


def search_records_many(
    index: Index, folded: DataFrame | Grams, queries: list[str], limit: int = 10, tenant: str | None = None, function_words: frozenset[str] = FUNCTION_WORDS, corpus: int | None = None
) -> DataFrame:
    """(query, pos, tier, seq, rank, part): retrieve, then verify, for several queries in one plan.

    Every distinct word is searched by the full ladder once, for all queries that have it. A word that
    finds nothing is dropped if it is a function word, else its query abstains. A record counts if the
    inverse frequencies of its words make up enough of the total, and it holds one of the query's rarest
    words or covers a good deal more. Asked for a final state, records that only prepare are left out.
    """
    spark = index.docs.sparkSession
    asked = [(i, place, w) for i, query in enumerate(queries) for place, w in enumerate(record_tokens(query))]
    words = list(dict.fromkeys(w for _, _, w in asked))
    if not words:
        return small(spark, [], "query int, pos int, tier string, seq long, rank double, part boolean")
    hits = _kept(ladder(index, folded, words, PER_WORD, tenant=tenant), len(words))
    final = {i for i, _, w in asked if w in FINAL_WORDS}
    rows = [(i, place, words.index(w), w in function_words, i in final) for i, place, w in asked]
    tokens = F.broadcast(small(spark, rows, "query int, place int, q int, little boolean, final boolean"))
    if corpus is None:
        own = index.docs.where(F.col("tier") == "entity")
        size = (own if tenant is None else own.where(F.col("tenant_id") == tenant)).agg(F.count(F.lit(1)).alias("corpus"))
    else:
        size = small(spark, [(corpus,)], "corpus long")
    every = Window.partitionBy("query")
    n = F.coalesce("n", F.lit(0))
    found = tokens.join(hits.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").withColumn("n", n).crossJoin(F.broadcast(size))  # one row
    found = found.withColumn("abstains", F.max((F.col("n") == 0) & ~F.col("little")).over(every)).where((F.col("n") > 0) & ~F.col("abstains"))
    found = found.withColumn("idf", F.log((F.col("corpus") + 1.0) / (F.col("n") + 1.0)) + 1)
    found = found.withColumn("total", F.sum("idf").over(every)).withColumn("rare", F.col("n") <= F.greatest(F.lit(2), F.bround(BAND * F.min("n").over(every))))
    # as many rows as the queries have words
    match = hits.join(F.broadcast(found.select("query", "place", "q", "idf", "total", "rare", "final")), "q")
    first = F.min(F.struct("place", F.col("pos").alias("at"), "seq", "rank", "part")).alias("first")
    records = match.groupBy("query", "final", "tier", "category", "key").agg(
        F.round(F.sum("idf") / F.first("total"), 12).alias("cover"), F.max("rare").alias("rare"), F.least(F.lit(0.0), F.min("rank")).alias("best"), first
    )
    kept = records.where((F.col("cover") >= FLOOR) & (F.col("rare") | (F.col("cover") >= HIGH))).select("query", "final", "tier", "first.*", "cover", "best")
    if final:  # drafts are told by their text
        low = F.lower(F.to_json(F.struct("body")))
        drafts = index.docs.join(F.broadcast(kept.where("final").select("query", "tier", "seq")), ["tier", "seq"]).where(F.rlike(low, F.lit(DRAFT_TEXT)) & ~F.rlike(low, F.lit(FINAL_TEXT)))
        kept = kept.join(drafts.select("query", "tier", "seq"), ["query", "tier", "seq"], "left_anti")
    order = every.orderBy(F.desc("cover"), F.col("tier") == "journal", "best", "place", "at")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= tx.clamp_limit(limit)).select("query", "pos", "tier", "seq", "rank", "part")

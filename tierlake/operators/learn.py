"""Pattern mining over journal events: repeated actions, shared shapes, co-occurrence, cadence.

Events are rows (seq, id, tenant_id, ts, evaluated, acted), the payloads JSON text. Every detector is
an aggregate with map-side combine; evidence keeps the first events of a group as a bounded array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Bounds that decide what is proposed.
MAX_EVENTS, MAX_TOKENS, MAX_EVIDENCE, MAX_PROPOSALS = 10_000, 64, 20, 20
KINDS = ("repeated_action", "structural_similarity", "co_occurrence", "temporal_routine")


def load(events: DataFrame, after_seq: int = 0, since: str | None = None, limit: int = MAX_EVENTS) -> DataFrame:
    """The next events past the watermark, or those after a time, in order of seq."""
    new = events.where(F.col("ts") > since) if since is not None else events.where(F.col("seq") > after_seq)
    return new.orderBy("seq").limit(limit)


def watermark(events: DataFrame) -> DataFrame:
    return events.agg(F.max("seq").alias("cursor_after_seq"), F.max("ts").alias("cursor_after_ts"), F.count(F.lit(1)).alias("events_scanned"))


def _kind(c: Column) -> Column:
    """The first of kind, action and type that is a non-empty string."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in ("kind", "action", "type")])


def signature(acted: Column) -> Column:
    """What an event did: the phrase of its string, of its list's first element, or of its object's kind."""
    first = F.get_json_object(acted, "$[0]")
    text = (
        F.when(F.startswith(acted, F.lit("[")), F.when(F.startswith(first, F.lit("{")), _kind(first)).otherwise(first))
        .when(F.startswith(acted, F.lit("{")), _kind(acted))
        .when(F.startswith(acted, F.lit('"')), F.get_json_object(F.concat(F.lit('{"s":'), acted, F.lit("}")), "$.s"))
    )
    return F.nullif(tx.phrase_col(text), F.lit(""))


def shape(evaluated: Column) -> Column:
    """The sorted keys of a non-empty object, joined."""
    keys = F.json_object_keys(evaluated)
    return F.when(F.size(keys) > 0, F.array_join(F.sort_array(keys), ","))


def tokens(event_cols: tuple[str, ...] = ("evaluated", "acted")) -> Column:
    """At most 64 distinct phrases of an event: its objects' keys, its lists' strings, its strings."""
    parts = []
    for name in event_cols:
        c = F.col(name)
        items = F.from_json(c, "array<string>")
        whole = F.array(F.get_json_object(F.concat(F.lit('{"s":'), c, F.lit("}")), "$.s"))
        words = F.when(F.startswith(c, F.lit("{")), F.json_object_keys(c)).when(F.startswith(c, F.lit("[")), items).when(F.startswith(c, F.lit('"')), whole)
        parts.append(F.coalesce(words, F.array().cast("array<string>")))
    phrases = F.transform(F.concat(*parts), tx.phrase_col)
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: F.coalesce(p != "", F.lit(False)))), 1, MAX_TOKENS)


def action_groups(events: DataFrame) -> DataFrame:
    """(detail, hits, first_seq) of each action."""
    rows = events.select("seq", signature(F.col("acted")).alias("detail")).where("detail is not null")
    return rows.groupBy("detail").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))


def shape_groups(events: DataFrame) -> DataFrame:
    """(detail, hits, first_seq) of each set of keys."""
    rows = events.select("seq", shape(F.col("evaluated")).alias("detail")).where("detail is not null")
    return rows.groupBy("detail").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))


def pairs_of(events: DataFrame) -> DataFrame:
    """(seq, a, b): the pairs of tokens in one event, in order. An event has at most 64 tokens, so at most 2,016 pairs."""
    one = events.select("seq", F.array_sort(tokens()).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.lit(MAX_TOKENS)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return one.select("seq", F.explode(pairs).alias("p")).select("seq", "p.a", "p.b")


#: Buckets of the first pass over pairs: what is broadcast after it is at most a number for each.
PAIR_BUCKETS = 1 << 20


def frequent_pairs(events: DataFrame, least: int, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """(seq, a, b): the pairs that can have ``least`` events, in two passes.

    The first pass counts hashes of pairs in a fixed number of buckets. A pair in a bucket of fewer than
    ``least`` is rare itself and is not made, and so not shuffled, in the second.
    """
    every = pairs_of(events)
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int")
    full = every.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("bucket")
    return every.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi").drop("bucket")


def pair_groups(events: DataFrame, least: int | None = None, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """(detail, hits, first_seq) of each pair of tokens; with ``least`` of those with as many events, found in two passes."""
    rows = pairs_of(events) if least is None else frequent_pairs(events, least, buckets)
    found = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))
    found = found if least is None else found.where(F.col("hits") >= least)
    return found.select(F.concat("a", F.lit(","), "b").alias("detail"), "hits", "first_seq")


def cadence(events: DataFrame) -> DataFrame:
    """(sig, hits, mean_gap, cov, first_seq): gaps between an action's events in minutes, and their variation."""
    rows = events.select("seq", signature(F.col("acted")).alias("sig"), F.try_to_timestamp(F.col("ts")).alias("at")).where("sig is not null")
    gap = (F.unix_micros("at") - F.lag(F.unix_micros("at")).over(Window.partitionBy("sig").orderBy("at"))) / 6e7
    timed = rows.where("at is not null").withColumn("gap", gap).groupBy("sig").agg(F.count(F.lit(1)).alias("hits"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"), F.min("seq").alias("first_seq"))
    return timed.select("sig", "hits", "mean_gap", F.when(F.col("mean_gap") > 0, F.col("sd") / F.col("mean_gap")).alias("cov"), "first_seq")


def _candidates(groups: DataFrame, kind: str, slug: Column, confidence: Column) -> DataFrame:
    return groups.select(F.lit(kind).alias("pattern_kind"), tx.slug_col(slug).alias("slug"), confidence.alias("confidence"), "hits", "detail", "first_seq")


def actions_of(groups: DataFrame, min_hits: int) -> DataFrame:
    sure = F.least(F.lit(0.95), 0.4 + 0.05 * F.col("hits"))
    return _candidates(groups.where(F.col("hits") >= max(2, min_hits)), KINDS[0], F.concat(F.lit("repeat-"), "detail"), sure)


def shapes_of(groups: DataFrame, min_hits: int) -> DataFrame:
    name = F.array_join(F.slice(F.split("detail", ","), 1, 4), "-")
    sure = F.least(F.lit(0.85), 0.3 + 0.04 * F.col("hits"))
    return _candidates(groups.where(F.col("hits") >= max(2, min_hits)), KINDS[1], F.concat(F.lit("shape-"), name), sure)


def co_occurrences_of(groups: DataFrame, min_hits: int) -> DataFrame:
    sure = F.least(F.lit(0.80), 0.25 + 0.04 * F.col("hits"))
    return _candidates(groups.where(F.col("hits") >= max(2, min_hits)), KINDS[2], F.concat(F.lit("pair-"), F.replace("detail", F.lit(","), F.lit("-"))), sure)


def routines_of(groups: DataFrame, min_hits: int, max_cov: float = 0.6) -> DataFrame:
    """``groups``: as ``cadence`` has them."""
    found = groups.where((F.col("hits") >= max(3, min_hits)) & (F.col("cov") < max_cov))
    said = F.concat("sig", F.lit(" every "), F.format_number(F.round("mean_gap", 1), 1), F.lit(" min"))
    return _candidates(found.withColumn("detail", said), KINDS[3], F.concat(F.lit("routine-"), "sig"), F.least(F.lit(0.9), 0.5 + 0.5 * (1 - F.col("cov"))))


def repeated_actions(events: DataFrame, min_hits: int = 3) -> DataFrame:
    return actions_of(action_groups(events), min_hits)


def shared_shapes(events: DataFrame, min_hits: int = 3) -> DataFrame:
    return shapes_of(shape_groups(events), min_hits)


def co_occurrence(events: DataFrame, min_hits: int = 3, buckets: int | None = None) -> DataFrame:
    """Pairs of tokens in one event. ``buckets`` finds them in two passes, for events with very many rare pairs."""
    return co_occurrences_of(pair_groups(events) if buckets is None else pair_groups(events, max(2, min_hits), buckets), min_hits)


def routines(events: DataFrame, min_hits: int = 3, max_cov: float = 0.6) -> DataFrame:
    return routines_of(cadence(events), min_hits, max_cov)


def propose(events: DataFrame, pending: DataFrame | None = None, min_hits: int = 3, most: int = MAX_PROPOSALS) -> DataFrame:
    """Candidates of all detectors: the best of each slug, then the most certain, then without pending slugs.

    Equals go by detector, then by the first event. Pending slugs are left out after the cut.
    """
    all_of = repeated_actions(events, min_hits).unionByName(shared_shapes(events, min_hits)).unionByName(co_occurrence(events, min_hits)).unionByName(routines(events, min_hits))
    return selected(all_of, pending, most)


def selected(candidates: DataFrame, pending: DataFrame | None = None, most: int = MAX_PROPOSALS) -> DataFrame:
    """Of candidates those that are proposed, as ``propose`` says."""
    ranked = candidates.withColumn("detector", F.array_position(F.array(*map(F.lit, KINDS)), F.col("pattern_kind")))
    best = ranked.groupBy("slug").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "detector", "first_seq", "pattern_kind", "confidence", "hits", "detail")).alias("b")).select("slug", "b.*")
    top = best.orderBy(F.desc("confidence"), "detector", "first_seq", "slug").limit(most)
    if pending is not None:
        top = top.join(pending.where("status = 'pending'").select(F.col("proposed_slug").alias("slug")).distinct(), "slug", "left_anti")
    return top.select("pattern_kind", "slug", "confidence", "hits", "detail", "first_seq")


def title_col(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "-", " "))


def rendered(proposals: DataFrame) -> DataFrame:
    """proposed_title and proposed_body (Markdown) of at most a few rows."""
    said = (
        F.when(F.col("pattern_kind") == KINDS[0], F.concat(F.lit("Recurring action: `"), "detail", F.lit("`")))
        .when(F.col("pattern_kind") == KINDS[1], F.concat(F.lit("Events share the input keys: `"), F.replace("detail", F.lit(","), F.lit(", ")), F.lit("`")))
        .when(F.col("pattern_kind") == KINDS[2], F.concat(F.lit("Appear together: `"), F.replace("detail", F.lit(","), F.lit("` and `")), F.lit("`")))
        .otherwise(F.concat(F.lit("Stable cadence: "), "detail"))
    )
    body = F.concat_ws("\n", F.concat(F.lit("# "), title_col(F.col("slug"))), F.lit(""), F.format_string("_Found in %d journal events._", F.col("hits")), F.lit(""), F.lit("## Pattern"), F.lit(""), said)
    return proposals.withColumn("proposed_title", title_col(F.col("slug"))).withColumn("proposed_body", body)


def all_evidence(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """(slug, evidence): JSON of the first twenty events of every proposal, whatever its kind; ``proposals`` are at most MAX_PROPOSALS rows."""
    parts = F.split("detail", ",")
    sig = F.when(F.col("pattern_kind") == KINDS[3], F.element_at(F.split("detail", " every "), 1)).otherwise(F.col("detail"))
    pair = F.col("pattern_kind") == KINDS[2]
    wanted = F.broadcast(proposals.select("slug", "pattern_kind", sig.alias("what"), F.when(pair, parts[0]).alias("a"), F.when(pair, parts[1]).alias("b")))
    rows = events.select("seq", "id", "ts", F.substring(F.coalesce("acted", "evaluated"), 1, 120).alias("snippet"), signature(F.col("acted")).alias("sig"), shape(F.col("evaluated")).alias("keys"), tokens().alias("t"))
    held = (
        (F.col("pattern_kind").isin(KINDS[0], KINDS[3]) & (F.col("sig") == F.col("what")))
        | ((F.col("pattern_kind") == KINDS[1]) & (F.col("keys") == F.col("what")))
        | ((F.col("pattern_kind") == KINDS[2]) & F.array_contains("t", F.col("a")) & F.array_contains("t", F.col("b")))
    )
    found = rows.join(wanted, held)
    firsts = found.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("seq"))).where(F.col("n") <= MAX_EVIDENCE)
    item = F.struct("seq", F.col("id").alias("event_id"), "ts", "snippet")
    return firsts.groupBy("slug").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda e: F.struct(e["event_id"].alias("event_id"), e["ts"].alias("ts"), e["snippet"].alias("snippet")))).alias("evidence"))


def redacted(events: DataFrame, columns: tuple[str, ...] = ("evaluated", "acted", "forward", "extra")) -> DataFrame:
    """(id, ts, shapes): events without their contents. An object is the number and the sorted lengths of its keys, a list its count, the rest a type."""
    def shown(c: Column) -> Column:
        keys = F.json_object_keys(c)
        return (
            F.when(F.startswith(c, F.lit("{")), F.to_json(F.struct(F.size(keys).alias("key_count"), F.sort_array(F.transform(keys, F.length)).alias("key_lens"))))
            .when(F.startswith(c, F.lit("[")), F.to_json(F.struct(F.json_array_length(c).alias("count"))))
            .when(F.startswith(c, F.lit('"')), F.lit('{"type":"str"}'))
            .when(c.isin("true", "false"), F.lit('{"type":"bool"}'))
            .when(F.rlike(c, F.lit("^-?[0-9]+$")), F.lit('{"type":"int"}'))
            .when(c.isNotNull() & (c != "null"), F.lit('{"type":"float"}'))
        )

    return events.select("id", "ts", *[shown(F.col(c)).alias(c) for c in columns if c in events.columns])


def review(proposals: DataFrame, id_: str, accept: bool, at: str, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The reviewed proposal row and the reference rows to append; empty unless the proposal is pending."""
    row = proposals.where((F.col("id") == id_) & (F.col("status") == "pending"))
    key = F.concat(F.lit("skill/"), "proposed_slug")
    done = row.withColumn("status", F.lit("accepted" if accept else "rejected")).withColumn("reviewed_at", F.lit(at)).withColumn("review_note", F.lit(note))
    done = done.withColumn("accepted_doc_key", key if accept else F.lit(None).cast("string"))
    meta = F.to_json(F.struct(F.lit("learner").alias("source"), "pattern_kind", "summarizer", "confidence", F.json_array_length(F.coalesce("evidence", F.lit("[]"))).alias("evidence_count"), F.col("proposed_title").alias("title")))
    refs = row.select(F.lit("put").alias("op"), "tenant_id", key.alias("doc_key"), F.col("proposed_body").alias("body"), meta.alias("metadata"), F.lit(at).alias("ts"))
    return done, refs if accept else refs.limit(0)


def list_proposals(proposals: DataFrame, status: str | None = "pending", limit: int = 50) -> DataFrame:
    rows = proposals if status is None else proposals.where(F.col("status") == status)
    return rows.orderBy(F.desc("confidence"), F.desc("created_at"), "id").limit(tx.clamp_limit(limit))

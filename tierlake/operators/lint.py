"""Data-quality checks: each is a DataFrame of findings (check, severity, message, detail)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import FREE_CAP, SCHEMA_VERSION

SEVERITIES = ("critical", "warning", "info")


@F.pandas_udf(T.BooleanType())  # type: ignore[call-overload]
def json_valid(text: pd.Series) -> pd.Series:
    """Strict JSON: no trailing text, no NaN or Infinity; repeated keys are fine; null is null."""

    def ok(t: str | None) -> bool | None:
        if t is None:
            return None
        try:
            json.loads(t, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
            return True
        except (ValueError, RecursionError):
            return False

    return text.map(ok)


#: What helps against a finding.
RECOVERY = {
    "schema-version": "Open the store with a current client, which notes its version.",
    "invalid-json-entity": "Write the entity again or delete it.",
    "invalid-json-state": "Write the document again or delete it.",
    "invalid-json-journal": "Correct the event's payload or take the event out.",
    "duplicate-entity": "Keep one category for the name; archive or rename the other entities.",
    "empty-reference": "Write the reference's text or delete it.",
    "stale-entity": "Confirm or archive what nobody has touched for long.",
    "journal-without-acts": "Give the event a payload or take it out.",
    "db-soft-cap": "Archive or delete old rows, or raise the cap.",
    "fts-rowcount-mismatch": "Rebuild the index.",
    "flagged-actors-fresh": "Look at the actor's record before acting on its messages.",
}


def finding(check: str, severity: str, message: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.cast("string").alias("message"), detail.cast("string").alias("detail")]


def schema_version(versions: DataFrame, expected: int = 2) -> DataFrame:
    top = versions.agg(F.max("version").alias("v")).where(F.coalesce("v", F.lit(0)) < expected)
    return top.select(*finding("schema-version", "critical", F.lit(f"schema is older than {expected}"), F.col("v")))


def json_doubtful(c: Column) -> Column:
    """Whether a text is not surely strict JSON. The parser stops at the end of a first value, so that text behind it would pass.

    Between brackets and as a member of an object only one whole value passes both. Repeated keys, deep nesting and
    very large texts are doubtful too.
    """
    whole = lambda before, after: F.try_parse_json(F.concat(F.lit(before), c, F.lit(after))).isNotNull()
    return c.isNotNull() & ~(whole("[", "]") & whole('{"a":', "}"))


def invalid_json(rows: DataFrame, check: str, key: Column, columns: list[str], most: int = 10) -> DataFrame:
    """Rows of which a column is no strict JSON; only rows that leave a doubt go to Python."""
    doubt = bad = F.lit(False)
    for c in columns:
        doubt = doubt | json_doubtful(F.col(c))
        bad = bad | ~F.coalesce(json_valid(F.col(c)), F.lit(True))
    return rows.where(doubt).where(bad).orderBy("seq").limit(most).select(*finding(check, "critical", F.lit("payload is not valid JSON"), key))


def duplicate_entities(entities: DataFrame) -> DataFrame:
    names = entities.groupBy("name").agg(F.count_distinct("category").alias("n")).where("n > 1")
    return names.select(*finding("duplicate-entity", "warning", F.col("name"), F.col("n")))


def empty_references(references: DataFrame) -> DataFrame:
    return references.where(F.col("body").isNull() | (F.length(F.trim("body")) == 0)).select(*finding("empty-reference", "warning", F.lit("reference has no text"), F.col("doc_key")))


def stale_entities(entities: DataFrame, as_of: str, days: int = 90, most: int = 25) -> DataFrame:
    cutoff = F.date_format(F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return entities.where(F.col("updated_at") < cutoff).orderBy("updated_at", "category", "name").limit(most).select(*finding("stale-entity", "info", F.col("updated_at"), F.concat_ws("/", "category", "name")))


def empty_events(journal: DataFrame, most: int = 10) -> DataFrame:
    none = F.coalesce("evaluated", "acted", "forward", "extra").isNull()
    return journal.where(none).orderBy(F.desc("ts"), F.desc("id")).limit(most).select(*finding("journal-without-acts", "info", F.col("ts"), F.col("id")))


def soft_cap(size: DataFrame, cap: int = FREE_CAP) -> DataFrame:
    """``size``: one row with column bytes."""
    share = F.col("bytes") / cap
    level = F.when(share >= 1, "critical").when(share >= 0.8, "warning")
    return size.where(level.isNotNull()).select(F.lit("db-soft-cap").alias("check"), level.alias("severity"), F.format_string("%.0f %% of the cap", share * 100).alias("message"), F.col("bytes").cast("string").alias("detail"))


def index_mismatch(entities: DataFrame, indexed: DataFrame) -> DataFrame:
    """Entities in the store against documents in the index; the two are counted apart."""
    both = entities.agg(F.count(F.lit(1)).alias("a")).crossJoin(indexed.where("tier = 'entity'").agg(F.count(F.lit(1)).alias("b")))  # one row each
    return both.where("a <> b").select(*finding("fts-rowcount-mismatch", "warning", F.lit("index and table differ"), F.concat_ws(":", "a", "b")))


def fresh_flags(flagged: DataFrame, as_of: str, days: int = 30, most: int = 5) -> DataFrame:
    cutoff = F.date_format(F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return flagged.where(F.col("flagged_at") >= cutoff).orderBy(F.desc("flagged_at"), "id").limit(most).select(*finding("flagged-actors-fresh", "info", F.coalesce("actor_handle", "actor_address"), F.col("reason")))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def lint(store, tenant: str, as_of: str, indexed: DataFrame | None = None) -> DataFrame:
    """All checks over one tenant of a store, with what helps; ``indexed``: (tier, seq) of the documents that an index holds."""
    e, s, r, j = (store.live(t, tenant) for t in ("entities", "state_documents", "reference_documents", "journal_events"))
    spark = store.spark
    parts = [
        schema_version(store.versions(), SCHEMA_VERSION),
        invalid_json(e, "invalid-json-entity", F.concat_ws("/", "category", "name"), ["body"]),
        invalid_json(s, "invalid-json-state", F.col("document_key"), ["body"]),
        invalid_json(j, "invalid-json-journal", F.col("id"), ["evaluated", "acted", "forward", "extra"]),
        duplicate_entities(e), empty_references(r), stale_entities(e, as_of), empty_events(j),
        soft_cap(spark.createDataFrame([(store.payload_bytes(tenant),)], "bytes long")),
        fresh_flags(store.scan("flagged_actors", tenant), as_of),
        *([index_mismatch(e, indexed.join(e.select("seq"), "seq", "left_semi"))] if indexed is not None else []),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    helps = F.create_map(*[F.lit(x) for pair in RECOVERY.items() for x in pair])
    return out.withColumn("recovery", F.try_element_at(helps, F.col("check")))


def report(findings: list) -> str:
    """A plain-text report of collected findings; it is fine when none is critical."""
    n = {s: sum(f["severity"] == s for f in findings) for s in SEVERITIES}
    lines = [f"{'OK' if not n['critical'] else 'FAILED'}: " + ", ".join(f"{n[s]} {s}" for s in SEVERITIES)]
    for f in findings:
        lines.append(f"[{f['severity']}] {f['check']}: {f['message']} ({f['detail']})")
        if f.get("recovery"):
            lines.append(f"    {f['recovery']}")
    return "\n".join(lines)

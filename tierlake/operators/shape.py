"""Shaping of results and conversations: budgets, prefetch merging, turn pairing, size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import FREE_CAP

#: What an answer may hold.
HIT_CHARS, BUDGET_CHARS = 1500, 200_000


def bounded(hits: DataFrame, order: list[Column], text: str = "body", each: int = HIT_CHARS, total: int = BUDGET_CHARS) -> DataFrame:
    """Hits with long texts cut, up to a total of characters; always at least one. ``hits`` is a query's result, bounded by its limit."""
    cut = F.when(F.length(text) > each, F.concat(F.substring(text, 1, each), F.lit("…"))).otherwise(F.col(text))
    rows = hits.withColumn("truncated", F.length(text) > each).withColumn(text, cut)
    w = Window.orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_n") == 1) | (F.col("_sum") <= total)).drop("_n", "_sum")


def merged(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Hits of several searches (tier, key, rank, ...) as one per key: most matches, then best rank, first."""
    per_key = hits.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("match_count"), F.min("rank").alias("best_rank"))
    return per_key.orderBy(F.desc("match_count"), "best_rank", "tier", "key").limit(limit)


def appended(stages: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of several stages (stage, pos, ...) joined so that a later stage never reorders or repeats what an earlier one has."""
    others = [c for c in stages.columns if c not in (*identity, "stage", "pos")]
    firsts = stages.groupBy(*identity).agg(F.min(F.struct("stage", "pos", *others)).alias("first"))
    return firsts.select(*identity, "first.*").orderBy("stage", "pos")


def paired_turns(turns: DataFrame, last: int = 20) -> DataFrame:
    """(conv_id, user_turn, turn, user_text, assistant_text): each assistant turn with the latest user turn not yet answered.

    Only the last turns of a conversation count, and only texts that are not blank. Of turns in
    order, an assistant's is paired iff the turn before it among users' and assistants' is a user's.
    """
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= last)
    rows = rows.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    before = lambda c: F.lag(c).over(order)
    rows = rows.select("conv_id", "turn", "role", "text", before("role").alias("r"), before("turn").alias("user_turn"), before("text").alias("user_text"))
    return rows.where("role = 'assistant' and r = 'user'").select("conv_id", "user_turn", "turn", "user_text", F.col("text").alias("assistant_text"))


def tier_status(size: DataFrame, cap: int = FREE_CAP, paid: bool = False) -> DataFrame:
    """One row: bytes, cap, share and flags; a paid store has no cap."""
    share = F.col("bytes") / cap
    return size.select("bytes", F.lit(None if paid else cap).cast("long").alias("cap"), F.lit(None).cast("double").alias("share") if paid else share.alias("share"), F.lit(False).alias("warning") if paid else (share >= 0.8).alias("warning"), F.lit(False).alias("full") if paid else (share >= 1).alias("full"))


def write_allowed(bytes_now: int, bytes_more: int, cap: int = FREE_CAP, paid: bool = False) -> bool:
    """Whether a write keeps the store under its cap; checked before a batch is appended."""
    return paid or bytes_now + bytes_more <= cap

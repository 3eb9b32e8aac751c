"""The learner as a stream: new journal files are mined as they arrive; the checkpoint is the watermark.

What is known of each pattern is state: a table of groups per micro-batch, made of the one before
and the batch's own groups. Counts and first events add up. Of an action's gaps the state has number, mean
and spread, which two runs of events that follow each other in time add up with the gap between them; the actions
of events that come late, before what is known, are reckoned again from the kept times of all their events.
So proposals are those of one batch with all events so far, however the files were dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import learn
from ..sources.tables import TABLES

#: Groups of what, how often, since which event; of timed actions the first and last time, and mean and spread (sum of squares) of the gaps.
_GROUPS = "kind string, detail string, hits long, first_seq long, first_at long, last_at long, mean double, m2 double"
_TIMES = "sig string, seq long, at long"
_TIMED = "timed"


def read_journal(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(TABLES["journal_events"]).option("maxFilesPerTrigger", max_files).parquet(path)


def _times(events: DataFrame) -> DataFrame:
    """(sig, seq, at): actions with a time, in microseconds."""
    at = F.unix_micros(F.try_to_timestamp(F.col("ts")))
    return events.select(learn.signature(F.col("acted")).alias("sig"), "seq", at.alias("at")).where("sig is not null and at is not null")


def _timed(times: DataFrame) -> DataFrame:
    gap = (F.col("at") - F.lag("at").over(Window.partitionBy("sig").orderBy("at"))) / 6e7
    found = times.withColumn("gap", gap).groupBy("sig").agg(
        F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.avg("gap").alias("mean"), (F.var_pop("gap") * F.count("gap")).alias("m2"),
    )
    return found.select(F.lit(_TIMED).alias("kind"), F.col("sig").alias("detail"), "hits", "first_seq", "first_at", "last_at", "mean", "m2")


def groups(events: DataFrame) -> DataFrame:
    """All groups of a batch of events, as state has them."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("first_at", "long"), ("last_at", "long"), ("mean", "double"), ("m2", "double"))]
    out = _timed(_times(events))
    for kind, part in ((learn.KINDS[0], learn.action_groups(events)), (learn.KINDS[1], learn.shape_groups(events)), (learn.KINDS[2], learn.pair_groups(events))):
        out = out.unionByName(part.select(F.lit(kind).alias("kind"), "detail", "hits", "first_seq", *none))
    return out


def _spread(parts: list[tuple[Column, Column, Column]]) -> tuple[Column, Column]:
    """Mean and sum of squares of several sets of gaps (number, mean, sum of squares) taken together."""
    n, mean, m2 = parts[0]
    for n_b, mean_b, m2_b in parts[1:]:
        both = n + n_b
        apart = mean_b - mean
        mean, m2, n = F.when(both > 0, (mean * n + mean_b * n_b) / both).otherwise(0.0), m2 + m2_b + F.when(both > 0, apart * apart * n * n_b / both).otherwise(0.0), both
    return mean, m2


def merged(state: DataFrame, new: DataFrame, times: DataFrame) -> DataFrame:
    """State and a later batch's groups as one state; ``times``: (sig, seq, at) of all events so far, read for late actions alone."""
    a, b = state.alias("a"), new.alias("b")
    both = a.join(b, ["kind", "detail"], "full")
    col = lambda side, name: F.col(f"{side}.{name}")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gaps = lambda side: F.greatest(F.coalesce(col(side, "hits"), F.lit(0)) - 1, F.lit(0))
    between = (col("b", "first_at") - col("a", "last_at")) / 6e7
    mean, m2 = _spread([(gaps("a"), zero(col("a", "mean")), zero(col("a", "m2"))), (F.when(between.isNotNull(), 1).otherwise(0), zero(between), F.lit(0.0)), (gaps("b"), zero(col("b", "mean")), zero(col("b", "m2")))])
    timed = F.col("kind") == _TIMED
    rows = both.select(
        "kind", "detail", (F.coalesce(col("a", "hits"), F.lit(0)) + F.coalesce(col("b", "hits"), F.lit(0))).alias("hits"), F.least(col("a", "first_seq"), col("b", "first_seq")).alias("first_seq"),
        F.least(col("a", "first_at"), col("b", "first_at")).alias("first_at"), F.greatest(col("a", "last_at"), col("b", "last_at")).alias("last_at"),
        F.when(timed, mean).alias("mean"), F.when(timed, m2).alias("m2"), F.coalesce(between < 0, F.lit(False)).alias("late"),
    )
    again = times.join(rows.where("late").select(F.col("detail").alias("sig")), "sig", "left_semi")
    return rows.where("not late").drop("late").unionByName(_timed(again))


def candidates(state: DataFrame, min_hits: int) -> DataFrame:
    """What the detectors find in a state."""
    of = lambda kind: state.where(F.col("kind") == kind)
    out = learn.actions_of(of(learn.KINDS[0]), min_hits).unionByName(learn.shapes_of(of(learn.KINDS[1]), min_hits)).unionByName(learn.co_occurrences_of(of(learn.KINDS[2]), min_hits))
    deviation = F.sqrt(F.col("m2") / F.greatest(F.col("hits") - 1, F.lit(1)))
    rhythm = of(_TIMED).select(F.col("detail").alias("sig"), "hits", F.when(F.col("hits") > 1, F.col("mean")).alias("mean_gap"), F.when(F.col("mean") > 0, deviation / F.col("mean")).alias("cov"), "first_seq")
    return out.unionByName(learn.routines_of(rhythm, min_hits))


def mine(journal: DataFrame, out: str, checkpoint: str, min_hits: int = 3):
    """After each micro-batch write the proposals of all events so far under ``out``/batch=N, the state under ``out``/_state.

    A batch that runs again makes its folders anew, of the state before it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.persist()
        try:
            _times(events).write.mode("overwrite").parquet(f"{out}/_times/{number}")
            state = groups(events)
            if number:
                times = spark.read.schema(_TIMES).parquet(*[f"{out}/_times/{i}" for i in range(number + 1)])
                state = merged(spark.read.schema(_GROUPS).parquet(f"{out}/_state/{number - 1}"), state, times)
            state.write.mode("overwrite").parquet(f"{out}/_state/{number}")
        finally:
            events.unpersist()
        state = spark.read.schema(_GROUPS).parquet(f"{out}/_state/{number}")
        learn.selected(candidates(state, min_hits)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return journal.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def action_counts(journal: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Actions per event-time window; events later than ``late`` are left out and their state is dropped."""
    rows = journal.select(F.try_to_timestamp(F.col("ts")).alias("at"), learn.signature(F.col("acted")).alias("sig")).where("at is not null and sig is not null")
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "sig").agg(F.count(F.lit(1)).alias("n"))

"""A training corpus from raw documents, in five stages.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; each stage is written as Parquet
and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import copies, language, packing, secrets, substring
from tierlake.llm.common import id_remainder, shared_path, text_of

#: Documents whose language is less certain than chance and this share of the rest are rejected; with four languages at 0.4.
LEAST_OVER_CHANCE = 0.2
#: Documents whose sets of word shingles of this width are at least this similar are near copies.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8


def _columns(docs: DataFrame, row: str, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, in their order, those of ``new`` replaced."""
    return [new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays uncertain; a null lang gets the prediction.

    What the model cannot judge stays: all documents if it knows no language, and those labelled with one it did not learn.
    """
    model = language.train(language.sample(docs, 500, 4000, 64, id_remainder("doc_id", 3) != 1))
    found = language.predicted(docs, model).where(F.rlike(text_of(F.col("row.text")), F.lit(r"\p{L}")))
    lang = F.col("row.lang")
    if model.labels:
        chance = 1 / len(model.labels)
        sure = F.col("score") >= chance + LEAST_OVER_CHANCE * (1 - chance)
        found = found.where(sure | F.coalesce(~lang.isin(model.labels), F.lit(False)))
        lang = F.coalesce(lang, "lang_pred")
    return found.select(*_columns(docs, "row", lang=lang))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near copies (five-word shingles, similarity 0.8 or more): that of the
    smallest id, null last; of different texts with that id the one of least hash, of rows that differ in other columns the
    first of these as JSON."""
    keyed = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), keyed("one").alias("r1"), keyed("two").alias("r2"), "doc_id", "text")
    found = copies.copies(rows, width=SHINGLE_WORDS, least=LEAST_SIMILARITY)
    ids = rows.select("r1", "r2", "doc_id").join(found, ["r1", "r2"])
    kept = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("k")).select("k.r1", "k.r2")
    rest = F.to_json(F.struct(*[F.col(f"row.`{c}`").alias(str(i)) for i, c in enumerate(docs.columns) if c != "text"]))
    one = rows.join(kept, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.min_by("row", rest).alias("row"))
    return one.select("row.*")


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words and more that also occur earlier; the blanks and line breaks of what stays are kept."""
    found = substring.deduplicate(docs, spaced=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    return found.select(*_columns(docs, "rest", text=text, n_chars=F.length(text).cast("long")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of several lengths; one row per piece."""
    return packing.pack(docs, packing.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", remove_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The tokenizer and the language model have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

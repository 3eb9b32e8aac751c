"""Text quality by compression with two dictionaries.

One zstandard dictionary is trained on text labelled good, another on text labelled bad. A text is
cut into chunks of about ``CHUNK`` bytes; each is compressed with either dictionary, and the
difference of the two sizes over their sum says which kind it is closer to. The size of a few
neutral bytes is added to every chunk, so that short ones stay near the average. The text's
difference is a low quantile over all its chunks, so that junk in a part of it shows. A logistic
curve, fitted on labelled texts that the dictionaries did not see, turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_remainder, table, text_of

CHUNK, NEUTRAL, QUANTILE, LEVEL = 1000, 20, 0.1, 3


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, [t[i : i + 4000] for t in texts for i in range(0, len(t), 4000)], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: float
    slope: float
    shift: float

    def __post_init__(self):
        self.coders = None

    def __getstate__(self):
        return self.__dict__ | {"coders": None}

    def difference(self, text: str) -> float:
        if self.coders is None:
            self.coders = []
            for data in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=LEVEL)
                self.coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
        data = text.encode()
        n = max(1, round(len(data) / CHUNK))
        good, bad = self.coders
        out = np.empty(n)
        for i in range(n):
            part = data[len(data) * i // n : len(data) * (i + 1) // n]
            a, b = len(good.compress(part)), len(bad.compress(part))
            out[i] = (b - a + NEUTRAL * self.center) / (a + b + NEUTRAL)
        return float(np.quantile(out, QUANTILE))

    def score(self, text: str) -> float:
        z = self.slope * self.difference(text) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a slight pull to zero so that they stay finite."""
    scale = float(x.std()) or 1.0
    rows, beta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2), rows.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(labelled: list[tuple[str, int]], size: int = 112640) -> Model:
    """The model of (text, label) pairs; two of three build the dictionaries, the third calibrates.

    With one label only, or none, every score is that label's share, smoothed: (ones + 1) / (n + 2).
    """
    good = [t.encode() for i, (t, y) in enumerate(labelled) if y and i % 3]
    bad = [t.encode() for i, (t, y) in enumerate(labelled) if not y and i % 3]
    rest = labelled[::3]
    if not good or not bad or len({y for _, y in rest}) < 2:
        share = (sum(y for _, y in labelled) + 1) / (len(labelled) + 2)
        return Model(b"", b"", 0.0, 0.0, math.log(share / (1 - share)))
    model = Model(_dictionary(good, size), _dictionary(bad, size), 0.0, 0.0, 0.0)
    raw = np.array([model.difference(t) for t, _ in rest])
    model.center = float(raw.mean())
    x = np.array([model.difference(t) for t, _ in rest])
    model.slope, model.shift = _logistic(x, np.array([y for _, y in rest], float))
    return model


def sample(docs: DataFrame, labels: DataFrame, per_label: int, chars: int, keep) -> list[tuple[str, int]]:
    """At most ``per_label`` labelled texts of either label (or as many characters from a hashed place), in the order of a hash.

    Labels of one document are reduced to the least; those without a document or a quality count for nothing. Of several
    texts of one id the least is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y")).where(keep(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("quality"), "doc_id")
    share = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    some = F.lit(False)
    for y, n in counts.items():
        some = some | ((F.col("y") == y) & (share < min(1.0, 1.5 * per_label / n)))
    out: list[tuple[int, int, int]] = []  # at most per_label of either label, whatever the tables' size
    seen = {0: 0, 1: 0}
    for r in sorted(known.where(some).select(order.alias("o"), "doc_id", "y").collect()):
        seen[r["y"]] += 1
        if seen[r["y"]] <= per_label:
            out.append((r["o"], r["doc_id"], r["y"]))
    kind = known.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(out, f"o long, doc_id {kind}, y int"))
    start = F.pmod("o", F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    texts = docs.select("doc_id", text_of("text").alias("text")).join(chosen, "doc_id").select("o", "y", F.col("text").substr(start, F.lit(chars)).alias("text"))
    return [(r["text"], r["y"]) for r in sorted(texts.groupBy("o", "y").agg(F.min("text").alias("text")).select("o", "y", "text").collect())]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with columns score (0 to 1, higher: the good label is likelier) and predicted, from whole texts.

    A null text counts as empty; an empty one has the neutral difference. Columns of these names
    are replaced; an empty table gives an empty one. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.score(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(p, pa.float64())], names=["row", "score"])

    rows = docs.select(text_of(text_col).alias("text"), F.struct("*").alias("row"))
    found = rows.transform(arrow_map, run, T.StructType().add("row", rows.schema["row"].dataType).add("score", "double"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str, per_label: int = 2000, chars: int = 20000) -> DataFrame:
    """Fits on at most ``per_label`` rows of either label, of ``chars`` characters; scores all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lambda c: id_remainder("doc_id", 4) == 2
    model = fit(sample(docs, table(spark, sf_dir, "labels"), per_label, chars, lambda c: ~held(c)))
    return score(docs, model).select("doc_id", held(None).alias("held_out"), "score", "predicted")

"""Language identification by a byte convolutional network, trained in numpy.

Bytes fall into classes (letters without case, other ASCII, every byte of multi-byte characters),
each with an embedding. Filters of several widths run over a window of fixed length; each filter's
largest response in the window goes through a rectifier to a softmax over the languages. Training
is plain back-propagation with Adam on windows of labelled text.

To apply it, every filter's response is taken apart into sums over one or two neighbouring bytes,
which are tables; whole texts are cut into windows, batches of windows gather from the tables, and
a text's prediction is the mean of its windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_remainder, table, text_of

WINDOW = 128
WIDTHS = (2, 3, 4)
CLASSES = 1 + 26 + 1 + 128
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = _KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(1, 27)
_KIND[[*b"0123456789"]] = 27
_KIND[128:] = np.arange(28, 156)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class windows (n, WINDOW) of whole texts, the last of each filled up, and the text each is of."""
    raw = [t.encode() for t in texts]
    counts = [max(1, -(-len(b) // WINDOW)) for b in raw]
    joined = b"".join(b.ljust(n * WINDOW) for b, n in zip(raw, counts))
    return _KIND[np.frombuffer(joined, np.uint8)].reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    filters: list[np.ndarray] = field(default_factory=list)  # of width w: (w, embedding, filters)
    bias: list[np.ndarray] = field(default_factory=list)
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tables: list = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"tables": []}

    def probabilities(self, kinds: np.ndarray) -> np.ndarray:
        """Softmax of every window."""
        if len(self.labels) == 1:
            return np.ones((len(kinds), 1))
        if not self.tables:
            one = lambda w: self.embed @ w
            pair = lambda a, b: (one(a)[:, None, :] + one(b)[None, :, :]).reshape(CLASSES * CLASSES, -1)
            a, b, c = self.filters
            self.tables = [t.astype(np.float32) for t in (pair(a[0], a[1]), pair(b[0], b[1]), one(b[2]), pair(c[0], c[1]), pair(c[2], c[3]))]
        t2, t3, t3c, t4, t4b = self.tables
        out = np.empty((len(kinds), len(self.labels)))
        for at in range(0, len(kinds), 64):
            k = kinds[at : at + 64].astype(np.int32)
            p = k[:, :-1] * CLASSES + k[:, 1:]
            three = t3[p[:, :-1]]
            three += t3c[k[:, 2:]]
            four = t4[p[:, :-2]]
            four += t4b[p[:, 2:]]
            tops = np.concatenate([x.max(1) for x in (t2[p], three, four)], 1)
            z = np.maximum(tops + np.concatenate(self.bias), 0) @ self.dense + self.shift
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 64] = z / z.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its probability."""
        if not self.labels:
            return [("und", 0.0)] * len(texts)
        kinds, owner = windows(texts)
        letters = (((kinds > 0) & (kinds != 27)).sum(1) + 1e-3)[:, None]
        total = np.zeros((len(texts), len(self.labels)))
        np.add.at(total, owner, self.probabilities(kinds) * letters)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        return [(self.labels[b], float(min(1.0, p[b]))) for b, p in zip(best.tolist(), total)]


def train(labelled: list[tuple[str, str]], per_text: int = 4, size: int = 8, count: int = 16, steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit the network on (text, language) pairs; the same pairs give the same model."""
    labels = sorted({y for _, y in labelled})
    if len(labels) < 2:
        return Model(labels)
    rng = np.random.default_rng(seed)
    kinds, owner = windows([t for t, _ in labelled])
    full = (kinds > 0).mean(1) > 0.3
    full = full if full.any() else np.ones(len(kinds), bool)
    kinds, owner = kinds[full], owner[full]
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1)) if len(owner) else np.empty(0, int)
    keep = [s + rng.permutation(n)[:per_text] for s, n in zip(first, np.diff(np.append(first, len(owner))))]
    keep = np.concatenate(keep) if keep else np.empty(0, int)
    if not len(keep):
        return Model(labels[:1])
    kinds, target = kinds[keep].astype(np.int64), np.array([labels.index(labelled[o][1]) for o in owner[keep]])
    by_label = [np.flatnonzero(target == j) for j in range(len(labels)) if (target == j).any()]
    embed = rng.normal(0, 0.5, (CLASSES, size))
    filters = [rng.normal(0, 1 / np.sqrt(w * size), (w, size, count)) for w in WIDTHS]
    bias = [np.zeros(count) for _ in WIDTHS]
    dense, shift = rng.normal(0, 1 / np.sqrt(count * len(WIDTHS)), (count * len(WIDTHS), len(labels))), np.zeros(len(labels))
    params = [embed, *filters, *bias, dense, shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ix, batch // len(by_label) + 1) for ix in by_label])  # languages in equal parts
        x, y = kinds[pick], target[pick]
        n = len(pick)
        e = embed[x]
        tops, places = [], []
        for w, f, b in zip(WIDTHS, filters, bias):
            spread = sum(e[:, j : WINDOW - w + 1 + j] @ f[j] for j in range(w))
            place = spread.argmax(1)
            tops.append(np.take_along_axis(spread, place[:, None, :], 1)[:, 0] + b)
            places.append(place)
        hidden = np.maximum(np.concatenate(tops, 1), 0)
        z = hidden @ dense + shift
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ dense.T) * (hidden > 0)
        g_embed, g_filters, g_bias = np.zeros_like(embed), [], []
        for i, (w, f, place) in enumerate(zip(WIDTHS, filters, places)):
            g = back[:, i * count : (i + 1) * count]
            g_bias.append(g.sum(0))
            grad = np.zeros_like(f)
            for j in range(w):  # only each filter's largest response passes a gradient
                at = x[np.arange(n)[:, None], place + j]
                grad[j] = np.einsum("nfe,nf->ef", embed[at], g)
                np.add.at(g_embed, at, g[:, :, None] * f[j].T[None])
            g_filters.append(grad)
        grads = [g_embed, *g_filters, *g_bias, hidden.T @ p, p.sum(0)]
        for q, g, mm, vv in zip(params, grads, m, v):
            g = g + 1e-4 * q
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q -= rate * (1 - step / (steps + 1)) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Model(labels, embed, filters, bias, dense, shift)


def sample(docs: DataFrame, per_language: int, chars: int, max_languages: int, keep) -> list[tuple[str, str]]:
    """At most ``per_language`` texts (or as many characters from a hashed place) of each of the commonest languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & keep)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    order = F.xxhash64(F.lit("language"), "doc_id")
    share = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    some = F.lit(False)
    for lang, n in counts.items():
        some = some | ((F.col("lang") == lang) & (share < min(1.0, 1.5 * per_language / n)))
    start = F.pmod(order, F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    rows = known.where(some).select(order.alias("o"), "lang", F.col("text").substr(start, F.lit(chars)).alias("text")).collect()
    out, seen = [], dict.fromkeys(counts, 0)
    for r in sorted(rows):
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= per_language:
            out.append((r["text"], r["lang"]))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``predicted`` beside the columns of ``docs``; columns named lang_pred and score are replaced."""
    found = predicted(docs, model, text_col)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score")


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) from whole texts, the rows of ``docs`` as one column, so that no name can clash.

    A null text and one without a letter are ``und`` with score 0, as is every text if the model
    knows no language. An empty table gives an empty one. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[str, float]] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                out += model.predict(texts[at:end])
                at = end
            named = [p if has else ("und", 0.0) for p, has in zip(out, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([n for n, _ in named], pa.string()), pa.array([s for _, s in named], pa.float64())], names=["row", "lang_pred", "score"])

    rows = docs.select(text_of(text_col).alias("text"), F.rlike(text_of(text_col), F.lit(r"\p{L}")).alias("letters"), F.struct("*").alias("row"))
    return rows.transform(arrow_map, run, T.StructType().add("row", rows.schema["row"].dataType).add("lang_pred", "string").add("score", "double"))


def op3_language(spark: SparkSession, sf_dir: str, per_language: int = 500, chars: int = 4000, max_languages: int = 64) -> DataFrame:
    """Fits on at most ``per_language`` rows of each language, of ``chars`` characters; predicts all rows."""
    docs = table(spark, sf_dir, "documents")
    held = id_remainder("doc_id", 3) == 1
    model = train(sample(docs, per_language, chars, max_languages, ~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

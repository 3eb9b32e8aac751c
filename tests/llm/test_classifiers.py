import zlib

import numpy as np
import zstandard

from tierlake.llm import language, quality

EDGE = "doc_id long, text string, lang string, score string, `a row, <of> x` int"


def edge(spark):
    rows = [(1, None, None, "s", 1), (2, "", "en", "s", 1), (3, "123 !?", "en", "s", 2), (4, "the and " * 40000, None, None, None), (None, "x", "en", "s", 1), (5, "日本語", "en", "s", 1), (5, "日本語", "en", "s", 1)]
    return spark.createDataFrame(rows, EDGE)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op3_language(spark, sf).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id].lang)
    assert np.mean(right) > 0.95, np.mean(right)


def test_language_tables_equal_plain_convolution():
    texts = [("abc de " * 30, "x"), ("fgh ij " * 30, "y"), ("ü ß kl " * 30, "z")] * 5
    model = language.train(texts, steps=20)
    kinds, _ = language.windows(["abü fg hi" * 20])
    e = model.embed[kinds]
    tops = np.concatenate([sum(e[:, j : language.WINDOW - w + 1 + j] @ f[j] for j in range(w)).max(1) + b for w, f, b in zip(language.WIDTHS, model.filters, model.bias)], 1)
    z = np.maximum(tops, 0) @ model.dense + model.shift
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(p, model.probabilities(kinds), atol=1e-4)


def test_language_edges(spark):
    docs = edge(spark)
    model = language.train([("the and of " * 20, "en"), ("der und die " * 20, "de")] * 4, steps=60)
    got = language.predict(docs, model)
    assert sorted(got.columns) == sorted([*docs.columns, "lang_pred"])
    rows = got.collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.train([])).collect()} == {"und"}
    assert {r.lang_pred for r in language.predict(docs, language.train([("a", "en")])).collect()} == {"und", "en"}


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op7_quality(spark, sf).collect()
    assert len(got) == 10000
    held = [(r.score, labels[r.doc_id]) for r in got if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad[None]).mean() > 0.96
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.93


def test_quality_edges(spark):
    docs = edge(spark)
    model = quality.fit([("the and of on " * 9, 1), ("$$$ !! ### " * 9, 0)] * 30)
    got = quality.score(docs, model)
    assert sorted(got.columns) == sorted([*docs.columns, "predicted"]) and got.count() == 7
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit([]).score("x") == 0.5 and abs(quality.fit([("a", 1)] * 8).score("x") - 0.9) < 1e-9


def plain_language(model, text):
    """Whole text in windows, every filter at every place, probabilities weighted by letters."""
    raw = text.encode()
    n = max(1, -(-len(raw) // language.WINDOW))
    total = np.zeros(len(model.labels))
    for i in range(n):
        kinds = language._KIND[np.frombuffer(raw[i * language.WINDOW : (i + 1) * language.WINDOW].ljust(language.WINDOW), np.uint8)]
        e = model.embed[kinds]
        tops = [max(0, max(float((e[j : j + w] * f[:, :, c]).sum()) for j in range(language.WINDOW - w + 1)) + b[c]) for w, f, b in zip(language.WIDTHS, model.filters, model.bias) for c in range(f.shape[2])]
        z = np.array(tops) @ model.dense + model.shift
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * (sum((kinds > 0) & (kinds != 27)) + 1e-3)
    total /= total.sum()
    return model.labels[int(total.argmax())], float(total.max())


def test_language_query_by_brute_force(spark, sf, monkeypatch):
    models, train = [], language.train
    monkeypatch.setattr(language, "train", lambda *a: models.append(train(*a)) or models[-1])
    got = {r.doc_id: r for r in language.op3_language(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        if len(t) > 1500:
            continue
        name, score = plain_language(models[0], t) if any(c.isalpha() for c in t) else ("und", 0.0)
        assert abs(got[d].score - score) < 1e-3 and (got[d].lang_pred == name or abs(score - 1 / len(models[0].labels)) < 0.3)


def test_language_without_letters_in_training(spark):
    model = language.train([("12 34 56 " * 20, "x"), ("!! ?? -- " * 20, "y")] * 3, steps=5)
    assert model.labels == ["x", "y"] and all(0 <= s < 1 for _, s in model.predict(["abc", "12"]))


def test_quality_query_by_brute_force(spark, sf, monkeypatch):
    models, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r.doc_id: r for r in quality.op7_quality(spark, sf).collect()}
    model = models[0]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    sizes = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    for d, t in texts.items():
        raw = t.encode()
        n = max(1, round(len(raw) / quality.CHUNK))
        rows = []
        for i in range(n):
            part = raw[len(raw) * i // n : len(raw) * (i + 1) // n]
            a, b = (len(c.compress(part)) for c in sizes)
            rows.append((b - a + quality.NEUTRAL * model.center) / (a + b + quality.NEUTRAL))
        want = 1 / (1 + np.exp(-(model.slope * np.quantile(rows, quality.QUANTILE) + model.shift)))
        assert abs(got[d].score - want) < 1e-9 and got[d].predicted == (want >= 0.7)


def test_quality_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i // 2, f"good text {i} " * 20 if i % 4 < 2 else f"$$ {i} ## " * 20) for i in range(80)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id int, quality int")
    found = quality.sample(docs, labels, 100, 1000, lambda c: c >= 0)
    assert len(found) == 40 and {y for _, y in found} == {0, 1}

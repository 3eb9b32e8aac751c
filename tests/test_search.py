import json
import random
import re
import sqlite3

import pytest

from tierlake.functions import text as tx
from tierlake.functions.porter import terms_col
from tierlake.operators import index, search
from tierlake.plans import catalog


def entities(spark, rows):
    """rows: (category, name, body)"""
    data = [(i + 1, "t", c, n, None, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False), "2024", "2024") for i, (c, n, b) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, tenant_id string, category string, name string, status string, body string, created_at string, updated_at string")


def built(spark, rows, **options):
    made = index.build(index.searchable(entities=entities(spark, rows)), **options)
    made = index.Index(made.docs.cache(), made.postings.cache(), made.stats.cache())
    return made, index.folded(made.docs)


def keys(df):
    return [r.key for r in df.orderBy("pos").collect()]


def test_rank_matches_a_full_text_table(spark):
    rows = [("note", f"n{i}", " ".join(f"word{(i * j) % 7} running" if j % 3 else "fox" for j in range(1, 3 + i % 5))) for i in range(30)]
    made, _ = built(spark, rows, terms=terms_col)
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, category, body, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text tables here")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(n, c, b) for c, n, b in rows])
    for q in (["word3"], ["fox", "run"], ["word1", "word2"]):
        want = con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid LIMIT 10", (" ".join(f'"{w}"' for w in q),)).fetchall()
        got = sorted(search.rank_words(made, [q], 10).collect(), key=lambda r: r.pos)
        assert [r.seq for r in got] == [w[0] for w in want]
        assert all(abs(r["rank"] - w[1]) < 1e-9 for r, w in zip(got, want))


def test_every_match_without_a_limit(spark):
    rows = [(i, "t", f"k{i}", f"the of estion inging est x{i}", "2024") for i in range(10_003)]
    made, folded = built_references(spark, rows)
    assert search.rank_words(made, [["the", "of"], ["estion"]], None).groupBy("variant").count().orderBy("variant").collect() == [(0, 10_003), (1, 10_003)]
    assert search.rank_substrings(folded, ["inging est"], None).count() == 10_003
    assert search.rank_substrings(folded, ["?"], None).columns == ["variant", "tier", "seq", "rank"]


def built_references(spark, rows):
    made = index.build(index.searchable(reference=spark.createDataFrame(rows, "seq long, tenant_id string, doc_key string, body string, updated_at string")))
    return made, index.folded(made.docs)


def test_queries_of_every_match_have_no_cap(spark, tmp_path):
    rows = [(i, "the of estion inging est" + " oution" * (i == 10_002), "en", "s", 24) for i in range(10_003)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("proximity_bucket", "bm25_or", "substring_and"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 10_003, name
    assert catalog.relax_first_hit(spark, str(tmp_path)).first().hits == 10_003
    assert catalog.prefetch_merge(spark, str(tmp_path)).first()[:] == (10_002, 2)


def test_near_words_first(spark):
    rows = [("n", "long", {"note": "filler " * 30 + "red fox " + "filler " * 30}), *(("n", f"s{i}", {"note": f"red {'x ' * 9} fox"}) for i in range(3))]
    made, folded = built(spark, rows)
    got = keys(search.search(made, folded, "red fox"))
    assert got[0] == "long" and len(got) == 4
    assert keys(search.search_entities(made, "red fox", category="none")) == []


def test_prefix(spark):
    made, folded = built(spark, [("n", "a", "cache running"), ("n", "b", "cash running"), ("n", "c", "running")])
    assert sorted(keys(search.search(made, folded, "running ca", prefix=True))) == ["a", "b"]
    assert sorted(keys(search.search(made, folded, "running cac", prefix=True))) == ["a"]


def test_substrings_and_folds(spark):
    rows = [("n", "cjk", "東京都の天気"), ("n", "pl", "Wydarzenie w Bełżycach"), ("n", "zulu", "ngiyakuthanda kakhulu"), ("n", "de", "Straßenbahn")]
    made, folded = built(spark, rows)
    for q, want in (("東京", "cjk"), ("belż", "pl"), ("thanda", "zulu"), ("strassen", "de")):
        assert keys(search.search(made, folded, q)) == [want], q
    assert keys(search.search(made, folded, "zz")) == []


def test_append_keeps_the_head(spark):
    made, folded = built(spark, [("en", "a", "new packshots today"), ("en", "exact", "packshot"), ("pl", "b", "nowe packshoty")])
    got = keys(search.search(made, folded, "packshot"))
    assert got[0] == "exact" and set(got) == {"a", "exact", "b"}


def test_stem_rescue(spark):
    made, folded = built(spark, [("n", "a", "status zamówienia"), ("n", "b", "lista reklamacje")])
    assert "b" in keys(search.search(made, folded, "status reklamacji"))


def test_single_word_head_gives_room(spark):
    rows = [("n", f"junk{i}", f"wspolny wpis numer{i}") for i in range(8)] + [("n", "target", "inny tekst magazynach")]
    made, folded = built(spark, rows)
    got = keys(search.search(made, folded, "wspolny magazynami", limit=8))
    assert len(got) == 8 and "target" in got


def test_phrasing(spark):
    made, folded = built(spark, [("n", "deploy", {"note": "the deployment window opens friday"}), ("n", "lunch", {"note": "lunch is at noon"})])
    assert keys(search.search(made, folded, "when does the deployment window open"))[0] == "deploy"
    assert keys(search.search(made, folded, "quarterly earnings")) == []
    assert keys(search.search(made, folded, "?!")) == []


def test_records_of_one_anchor(spark):
    n, rows = 24, []
    for i in range(n):
        g = i % 2
        for kind in ("report", "email", "journal", "bug"):
            rows.append((kind, f"{kind}-{i}", {"text": f"co{i:04d} topic{g}alpha topic{g}beta {kind} words"}))
    made, folded = built(spark, rows)
    got = search.search_records(made, folded, "co0007 topic1alpha topic1beta", limit=50)
    assert sorted(keys(got)) == sorted(f"{k}-7" for k in ("report", "email", "journal", "bug"))
    assert keys(search.search_records(made, folded, "co0007 unheardof")) == []
    assert sorted(keys(search.search_records(made, folded, "when was co0007 filed report", function_words=search.FUNCTION_WORDS | {"filed"}))) != []


def test_final_state_leaves_drafts_out(spark):
    made, folded = built(spark, [("n", "draft", "budget draft approved? no: pending"), ("n", "plan", "budget planning closed"), ("n", "prep", "budget forecast sent"), ("n", "x", "budget triage closedx")])
    assert "x" not in keys(search.search_records(made, folded, "budget closed"))


def test_tenants_and_tiers(spark):
    rows = spark.createDataFrame([(1, "a", "c", "n1", None, "shared word", "t", "t"), (2, "b", "c", "n2", None, "shared word", "t", "t")], "seq long, tenant_id string, category string, name string, status string, body string, created_at string, updated_at string")
    made = index.build(index.searchable(entities=rows))
    folded = index.folded(made.docs)
    assert keys(search.search(made, folded, "shared", tenant="b")) == ["n2"]
    with pytest.raises(ValueError):
        search.search(made, folded, "shared", tiers=("nowhere",))
    assert keys(search.search(made, folded, "shared", limit=0)) == []


def test_saved_index(spark, tmp_path):
    made, folded = built(spark, [("n", "a", "alpha beta"), ("n", "b", "alpha")])
    saved = made.save(str(tmp_path / "ix"), 2)
    assert [r.seq for r in search.rank_words(saved, [["alpha", "beta"]], 5).collect()] == [1]


def test_snippet():
    assert search.snippet("one two three", ["two"]) == "one [two] three"
    assert search.snippet("w " * 20 + "end", ["end"]).startswith("...")


def saved_references(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "seq long, tenant_id string, doc_key string, body string, updated_at string")
    return index.build(index.searchable(reference=df), **options).save(str(tmp_path / "ix"), 4)


def test_trigram_postings_answer_like_a_scan(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("abAB é東京ł_1 ") for _ in range(r.randrange(0, 60))) for _ in range(150)]
    texts += ["", "a", "ab", "abab", "東", "ba東", "x" * 500 + "needle" + "y" * 300, "aaaaaaaa", "😀😀😀a", "needle"]
    rows = [(i, "t" if i % 3 else "u", f"k{i}", t, "2024") for i, t in enumerate(texts)] + [(0, "t", "k0", texts[0], "2024")] * 0
    monkeypatch.setattr(index, "GRAM_CHARS", 100)  # texts in pieces, blocks of a few texts
    saved = saved_references(spark, tmp_path, rows, terms=index.WORDS)
    scanned, grams = index.folded(saved.docs).cache(), saved.substrings()
    assert isinstance(grams, index.Grams)
    queries = ["aba", "ab", "東", "東京 ab", "needle", "aaaa", "b_1 é", "abab ba", "京", "zzz", "?", "xxxxxxxneedleyyy", "😀😀", "é1", "k1", "aab bab"]
    for tenant in (None, "u"):
        got = {(x.variant, x.seq): x["rank"] for x in search.rank_substrings(grams, queries, None, tenant=tenant).collect()}
        want = {(x.variant, x.seq): x["rank"] for x in search.rank_substrings(scanned, queries, None, tenant=tenant).collect()}
        assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    top = [tuple(x) for x in search.rank_substrings(grams, ["aba", "b"], 7).collect()]
    assert len(top) == 7 and [x[2] for x in sorted(top, key=lambda x: x[4])] == [x.seq for x in search.rank_substrings(scanned, ["aba", "b"], 7).orderBy("pos").collect()]
    plan = search.rank_substrings(grams, ["needle"], 7)._jdf.queryExecution().toString()
    assert "folded" not in plan and "body" not in plan and "In(gram" in plan.replace(" ", "")


def test_pruned_ranks_are_those_of_all_postings(spark, tmp_path, monkeypatch):
    """Blocks that cannot reach the limit are not read, whatever ties and tenants there are."""
    r = random.Random(7)
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    monkeypatch.setattr(index, "COMMON", 20)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 3)
    words = ["red", "fox", "tree", *[f"w{i}" for i in range(40)]]
    rows = [(i, "t" if i % 4 else "u", f"k{i}", " ".join(r.choices(words, [9, 6, 3, *[1] * 40], k=r.randrange(2, 80))), "2024") for i in range(900)]
    rows += [(1000 + i, "t", "same", "red fox red", "2024") for i in range(30)]
    saved = saved_references(spark, tmp_path, rows, terms=index.WORDS)
    variants = [["red"], ["red", "fox"], ["fox", "tree", "red"], ["red", "red"], ["w3", "red"], ["nowhere", "red"]]
    for limit, tenant in ((1, None), (5, None), (10, "u")):
        ask = lambda prune: sorted(map(tuple, search.rank_words(saved, variants, limit, tenant=tenant, prune=prune).collect()))  # noqa: E731, B023
        got, want = ask(True), ask(False)
        assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in want] and all(abs(x[4] - y[4]) < 1e-9 for x, y in zip(got, want))
    kept = search.best_blocks(saved, [["red"]], 5, index.TIERS, None).count()
    assert 0 < kept < saved.blocks.where("term = 'red'").count() / 2
    assert saved.documents() == 930 < search.PRUNE_FROM


def test_only_new_words_are_stemmed(spark, tmp_path):
    saved = saved_references(spark, tmp_path, [(1, "t", "a", "Running runs, RUNNING jumps", "2024")])
    assert {x.word: x.terms for x in saved.words.collect()} == {"a": ["a"], "running": ["run"], "runs": ["run"], "jumps": ["jump"]}
    assert {x.term: (x.tf, x.pos) for x in saved.postings.collect()} == {"a": (1, [0]), "run": (3, [2, 3, 4]), "jump": (1, [5])}
    marked = saved.words.withColumn("terms", index.F.array(index.F.concat(index.F.lit("known-"), "word")))
    more = spark.createDataFrame([(2, "t", "b", "runs swimming", "2024")], "seq long, tenant_id string, doc_key string, body string, updated_at string")
    again = index.build(index.searchable(reference=more)).save(str(tmp_path / "more"), 2, known=marked)
    assert {x.word: x.terms for x in again.words.collect()} == {"b": ["b"], "runs": ["known-runs"], "swimming": ["swim"]}
    assert {x.term for x in again.postings.collect()} == {"b", "known-runs", "swim"}


@pytest.mark.parametrize("analyzer", [index.WORDS, index.PORTER], ids=lambda a: a.name)
@pytest.mark.parametrize("saved", [False, True])
def test_nearness_from_places(spark, tmp_path, analyzer, saved):
    """As near as a walk over the words says: repeated words, inflections of one stem, words of two columns, gaps of every length."""
    r = random.Random(11)
    words = ["run", "running", "Runs", "fox", "foxes", "Café", "x_y", "a", "b", "c", "d"]
    rows = [(i, "t", r.choice(["run", "fox b", "key", "running fox"]), " ".join(r.choices(words, k=r.randrange(0, 40))), "2024") for i in range(250)]
    rows += [(900, "t", "run", "fox", "2024"), (901, "t", "", "", "2024"), (902, "t", "k", "run " * 3000 + "fox", "2024"), (903, "t", "k", "fox", "2024")]
    df = spark.createDataFrame(rows, "seq long, tenant_id string, doc_key string, body string, updated_at string")
    made = index.build(index.searchable(reference=df), analyzer)
    made = made.save(str(tmp_path / "ix"), 4) if saved else made
    variants = [["run", "fox"], ["fox", "run"], ["running", "run", "fox"], ["run", "run"], ["a", "b", "c", "a"], ["x_y", "café"], ["fox"], ["a", "nowhere"], ["_", "a"]]
    got = {(x.variant, x.seq): x.near for x in search.nearness(made, dict(enumerate(variants)), ("reference",)).collect()}
    want = {}
    for v, ws in enumerate(variants):
        plain = [p for w in ws for p in analyzer.words(w)]
        for seq, _, key, body, _ in rows:
            parts = [analyzer.words(t) for t in (key, body)]
            if len(ws) > 1 and {t for p in plain for t in analyzer.query(p)} <= {t for p in parts for w in p for t in analyzer.query(w)}:
                want[v, seq] = tx.proximity(plain, " | ".join(" ".join(p) for p in parts))
    assert got == want and set(want.values()) == {0, 1, 2} and len(want) > 300
    some = spark.createDataFrame([(0, "reference", 902), (1, "reference", 902), (0, "reference", 903)], "variant int, tier string, seq long")
    of_hits = search.nearness(made, dict(enumerate(variants)), ("reference",), some)
    assert sorted(map(tuple, of_hits.collect())) == [(0, "reference", 902, want[0, 902]), (1, "reference", 902, want[1, 902])]


def test_ranking_reads_no_text(spark, tmp_path):
    rows = [(i, "t", f"k{i}", f"red {'x ' * i}fox", "2024") for i in range(12)]
    saved = saved_references(spark, tmp_path, rows)
    heads = search._heads(saved, ["red fox"], 20, False, ("reference",), None)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert len(read) >= 2 and not any(column in schema for schema in read for column in ("body:", "text:"))
    assert [r.seq for r in heads.orderBy("pos").collect()] == list(range(12))
    found = search.search_entities(saved, "red fox")
    assert found.count() == 0


@pytest.mark.parametrize("analyzer", [index.WORDS, index.PORTER], ids=lambda a: a.name)
def test_postings_stay_with_their_documents(spark, tmp_path, monkeypatch, analyzer):
    """A document's postings and trigrams are in one file, so none are shuffled by term; block figures bound what the postings weigh."""
    monkeypatch.setattr(index, "COMMON", 2)
    monkeypatch.setattr(index, "COUNTED_WORDS", 40)  # several runs of a file
    rows = [(i, "t", f"k{i}", f"red running fox{i} " * (1 + i % 5), "2024") for i in range(60)]
    saved = saved_references(spark, tmp_path, rows, terms=analyzer)
    file = index.F.input_file_name().alias("file")
    assert saved.postings.select("seq", file).distinct().count() == 60
    assert saved.grams.postings.select(index.F.explode("seqs").alias("seq"), file).distinct().count() == 60
    blocks = {(b.term, b.block): (b.n, b.best) for b in saved.blocks.collect()}
    weigh = index.weight(index.F.col("tf"), index.F.col("dl"), index.F.col("avgdl"))
    found = saved.postings.join(saved.stats, "tier").groupBy("term", "block").agg(index.F.count("*").alias("n"), index.F.max(weigh).alias("most")).collect()
    common = [x for x in found if (x.term, x.block) in blocks]
    assert len(common) == len(blocks) > 0 and all(blocks[x.term, x.block][0] == x.n and blocks[x.term, x.block][1] >= x.most - 1e-9 for x in common)
    assert not (tmp_path / "ix" / "raw").exists() and not (tmp_path / "ix" / "blocks").exists()

import asyncio
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tierlake.functions import porter, text as tx
from tierlake.operators import index, learn, memory, search
from tierlake.sources import manifest, tables

from .test_search import built, keys


@pytest.fixture
def mem(spark, tmp_path):
    return memory.Memory(spark, str(tmp_path / "store"))


def full_text(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, category, body, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text tables here")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(n, c, b) for c, n, b in rows])
    return con


def test_queries_are_analyzed_as_documents_are(spark):
    """Ranks equal those of a full-text table for words as a user types them: inflected, accented, with underscores."""
    r = random.Random(8)
    words = ["deploys", "deploying", "deployed", "cluster", "Clusters", "café", "CAFE", "naïve", "snake_case", "snake", "case", "running", "runs", "relational", "łódź", "x_1_y", "42nd", "flies"]
    rows = [("cat_a" if i % 3 else "b", f"n{i}", " ".join(r.choice(words) for _ in range(r.randint(1, 14)))) for i in range(60)]
    rows += [("snake", "case", "none"), ("b", "end_snake", "case first")]  # no phrase over two columns
    made, folded = built(spark, rows)
    con = full_text(rows)
    for q in (["deploying"], ["cafe"], ["snake_case"], ["snake", "case"], ["Run", "cluster"], ["x_1_y"], ["naive", "deploy"], ["relate"], ["fly"], ["42ND"], ["cat_a"], ["łódź"]):
        want = con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid", (" ".join(f'"{w}"' for w in q),)).fetchall()
        got = sorted(((x.seq, x["rank"]) for x in search.rank_words(made, [q], None).collect()), key=lambda x: (round(x[1], 9), x[0]))
        assert {s for s, _ in got} == {s for s, _ in want}, q
        ranks = dict(got)
        assert all(abs(ranks[s] - x) < 1e-9 for s, x in want), q
    want = con.execute("SELECT rowid FROM t WHERE t MATCH ?", ("running clus*",)).fetchall()
    assert {x.seq for x in search.rank_words(made, [["running", "clus"]], None, prefix=True).collect()} == {w[0] for w in want}
    want = con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", ('"running clusters"',)).fetchall()
    got = {x.seq: x["rank"] for x in search.rank_phrase(made, "runs cluster", None).collect()}
    assert got.keys() == {w[0] for w in want} and all(abs(got[s] - x) < 1e-9 for s, x in want)


def test_plain_and_stemmed_terms(spark):
    rows = [("n", "a", "deploys the cluster"), ("n", "b", "snake_case naming"), ("n", "c", "café menu")]
    made, folded = built(spark, rows)
    for q, want in (("deploying", "a"), ("snake", "b"), ("snake_case", "b"), ("cafe", "c"), ("menus", "c")):
        assert keys(search.search(made, folded, q)) == [want]
    plain = index.build(made.docs, index.WORDS)
    assert search.rank_words(plain, [["deploying"]], None).count() == 0 and search.rank_words(plain, [["snake_case"]], None).count() == 1
    docs = spark.createDataFrame([("entity", "t", 1, ["a b", "", "B", "Ünder_scored x²"])], "tier string, tenant_id string, seq long, parts array<string>")
    got = {r.term: (r.tf, r.dl, r.pos) for r in index.postings_of(docs, index.PORTER).collect()}
    assert got == {"a": (1, 6, [0]), "b": (2, 6, [1, 4]), "under": (1, 6, [6]), "score": (1, 6, [7]), "x²": (1, 6, [8])}


def test_hits_have_snippets(spark):
    made, folded = built(spark, [("n", "a", "w " * 30 + "he deploys now"), ("n", "b", "Straßenbahn")])
    hit = search.search(made, folded, "deployed").first()
    assert "[deploys]" in hit.snippet and hit.snippet.startswith("...") and hit.body.endswith("now")
    assert search.search(made, folded, "strassen").first().snippet == "strassenbahn"


def test_overlapping_substrings(spark):
    made, folded = built(spark, [("n", "a", "anananan"), ("n", "b", "anan x ana yy"), ("n", "c", "zzz")])
    got = {r.seq: r["rank"] for r in search.rank_substrings(folded, ["anan"], 10).collect()}
    sizes = {r.seq: len(r.folded) - 2 for r in folded.collect()}
    mean = sum(sizes.values()) / 3
    want = {1: 3, 2: 1}  # places, overlapping ones too
    for s, tf in want.items():
        assert abs(got[s] + 1e-6 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[s] / mean))) < 1e-12
    both = search.rank_substrings(folded, ["anan", "zzz", "?", "yy"], 10).collect()
    assert {(r.variant, r.seq) for r in both} == {(0, 1), (0, 2), (1, 3)}


def test_index_follows_the_store(mem):
    mem.set_entity("p", "one", {"t": "deploys the cluster"})
    assert keys(mem.search("deploying")) == ["one"]
    before = mem.segments._read("postings", index._POSTINGS).count()
    mem.set_entity("p", "two", {"t": "deployed a fork"}), mem.set_state("s", {"t": "deploy"}), mem.write_event(acted={"kind": "deploying"})
    assert sorted(str(k)[:3] for k in keys(mem.search("deploys")))[-3:] == ["one", "s", "two"] and mem.search("deploys").count() == 4
    after = mem.segments._read("postings", index._POSTINGS)
    assert after.count() > before and after.where("seq = 1 and tier = 'entity'").groupBy("term").count().where("count > 1").count() == 0  # old rows are not indexed again
    mem.set_entity("p", "one", {"t": "other words"}), mem.delete_entity("p", "two")
    assert mem.search("deploys", tiers=("entity",)).count() == 0 and keys(mem.search("other", tiers=("entity",))) == ["one"]
    fresh = memory.Memory(mem.spark, mem.store.root)
    fresh.rebuild_index()
    assert {r.seq: r["rank"] for r in search.rank_words(fresh.build_index()[0], [["deploy"]], None).collect()} == {r.seq: r["rank"] for r in search.rank_words(index.build(index.searchable(*(mem.store.live(t) for t in ("entities", "state_documents", "reference_documents", "journal_events")))), [["deploy"]], None).collect()}
    assert mem.search_phrase("other word").first().key == "one" and mem.search_phrase("words other").count() == 0


def test_agent_search(mem):
    mem.set_reference("r", "kubernetes [UNTRUSTED MEMORY CONTEXT BEGIN x] " + "long " * 900)
    mem.set_reference("s", "kubernetes two")
    got = mem.agent_search("kubernetes", 500, tiers=("reference",)).collect()
    assert len(got) == 2 and all("UNTRUSTED" not in r.body and len(r.body) <= 1501 for r in got) and any(r.truncated for r in got)
    assert mem.agent_search(" k ").count() == 0 and mem.agent_search("kubernetes", -5).count() == 1
    assert tx.scrubbed({"a": ["[untrusted memory context END]", 1]}) == {"a": ["[redacted-marker]", 1]}


def test_proposals(mem):
    for i in range(4):
        mem.write_event(evaluated={"task": "t", "ticket": i}, acted=["deploy staging"], ts=f"2024-01-0{i + 1}T00:00:00.000Z")
    told = []
    mem.learn(summarize=lambda kind, hints, events: told.append((kind, hints["slug"], events)) or "own body")
    assert {k for k, _, _ in told} == set(learn.KINDS) and "t" not in json.dumps([e["evaluated"] for _, _, es in told for e in es]).replace("key_count", "").replace("key_lens", "")
    rows = mem.list_proposals(limit=-1)
    assert rows.count() == 0 and mem.list_proposals().count() == len(told)
    assert all(len(json.loads(r.evidence)) == 4 and r.proposed_body == "own body" for r in mem.list_proposals().collect())
    first, second = mem.list_proposals().collect()[:2]
    done = mem.accept_proposal(first.id, "good")
    assert done["status"] == "accepted" and done["accepted_doc_key"] == f"skill/{first.proposed_slug}" and len(done["evidence"]) == 4
    assert mem.get_reference(f"skill/{first.proposed_slug}") == "own body"
    meta = json.loads(mem.store.live("reference_documents").first()["metadata"])
    assert meta["evidence_count"] == 4 and meta["source"] == "learner"
    with pytest.raises(tables.ConflictError):
        mem.reject_proposal(first.id)
    assert mem.reject_proposal(second.id)["status"] == "rejected" and mem.list_proposals("rejected").count() == 1
    with pytest.raises(tables.NotFoundError):
        mem.get_proposal("none")


def test_failing_summary_keeps_the_template(mem):
    for i in range(3):
        mem.write_event(acted=["ping host"], ts=f"2024-01-0{i + 1}T00:00:00.000Z")

    def fails(*a):
        raise RuntimeError("no answer")

    mem.learn(summarize=fails)
    body = mem.list_proposals().first().proposed_body
    assert "no answer" in body and body.count("\n- 2024-01-0") == 3


def test_redaction(spark):
    rows = [(1, "a", "t", "ts", '{"secret":1,"k":2}', "[1,2]", '"text"', "1.5"), (2, "b", "t", "ts", None, "null", "true", "7")]
    df = spark.createDataFrame(rows, tables.TABLES["journal_events"])
    first, second = learn.redacted(df).orderBy("id").collect()
    assert json.loads(first.evaluated) == {"key_count": 2, "key_lens": [1, 6]} and json.loads(first.acted) == {"count": 2}
    assert json.loads(first.forward) == {"type": "str"} and json.loads(first.extra) == {"type": "float"}
    assert (second.evaluated, second.acted, json.loads(second.forward), json.loads(second.extra)) == (None, None, {"type": "bool"}, {"type": "int"})


def test_batches(mem, spark):
    rows = [("c", f"n{i}", json.dumps({"i": i}), f"2024-01-{i + 1:02d}") for i in range(5)]
    df = spark.createDataFrame(rows, "category string, name string, body string, ts string")
    assert mem.put_all("entities", df) == 5
    live = mem.store.live("entities").orderBy("seq").collect()
    assert [r.name for r in live] == [f"n{i}" for i in range(5)] and len({r.id for r in live}) == 5 and all(r.id for r in live)
    for bad in (("c", "x;y", "{}", "t"), ("c", "x", "3", "t"), ("c", "x", '{"a":', "t"), (None, "x", "{}", "t")):
        with pytest.raises(tables.ValidationError):
            mem.put_all("entities", spark.createDataFrame([*rows, bad], df.schema))
    assert mem.store.scan("entities").count() == 5
    with pytest.raises(tables.TenantError):
        mem.put_all("entities", df.withColumn("tenant_id", F.lit("other")))
    assert mem.set_entity("c", "n0", {})["id"] == live[0]["id"] and mem.get_entity("c", "n0")["body"] == {}
    with pytest.raises(tables.CapExceededError):
        mem.put_all("state_documents", spark.createDataFrame([(f"k{i}", json.dumps({"x": "y" * 900_000})) for i in range(6)], "document_key string, body string"))


def test_document_batches(mem):
    ops = [("put", ("a", "b"), "1", {"text": "deploys the cluster", "n": 1}), ("put", ("a",), "2", {"text": "cluster"}), ("put", ("z",), "3", {"text": "the deploying of a big cluster"}), ("get", ("a",), "2"), ("put", ("a",), "2", None), ("get", ("a",), "2"), ("namespaces",)]
    got = mem.batch(ops)
    assert got[3]["body"] == {"text": "cluster"} and got[5] is None and [r[0] for r in got[6]] == [["a", "b"], ["z"]]
    with pytest.raises(tables.ValidationError):
        mem.batch([("put", ("q",), "1", {}), ("put", ("a/b",), "1", {})])
    assert mem.get(("q",), "1") is None
    found = asyncio.run(mem.abatch([("find", {"query": "deployed clusters"})]))[0]
    assert [r.key for r in found] == ["1", "3"]  # the nearer words first
    assert [r.key for r in mem.find(("a",), query="deployed clusters").collect()] == ["1"]
    assert [r.key for r in mem.find(query="cluster", filter={"n": 1}).collect()] == ["1"] and mem.find(query="?!").count() == 0
    assert dict(mem.find().dtypes)["updated_at"] == "timestamp"


def test_small_verbs(mem):
    name = mem.mirror("add", "notes", "remember this", {"k": 1})
    assert len(name) == 12 and mem.get_entity("notes", name)["body"] == {"content": "remember this", "metadata": {"k": 1}}
    assert mem.mirror("remove", "notes", "remember this") == name and mem.recall("notes", name) is None and mem.mirror("add", "notes", "") is None
    mem.record_delegation("t", "r", "c", "s")
    event = mem.read_events().first()
    assert json.loads(event.evaluated) == {"delegated_task": "t", "child_sid": "c", "session_id": "s"} and json.loads(event.acted) == {"child_result": "r"}
    mem.set_entity("c", "a", {}), mem.set_entity("c", "b", {})
    assert mem.forget("c", "a") is True and mem.memory_forget("c", "b", "old")["archived_id"]
    assert mem.health() == {"entities": 0, "state_documents": 0, "journal_events": 1, "reference_documents": 0, "archived_entities": 1, "bytes": mem.store.payload_bytes(mem.tenant), "version": 4}


def test_relations_go_with_their_ends(mem):
    a, b = mem.set_entity("c", "a", {})["id"], mem.set_entity("c", "b", {})["id"]
    rows = mem.spark.createDataFrame([(1, "r", mem.tenant, a, b, "knows", None, "t")], tables.TABLES["entity_relations"])
    mem.store.append("entity_relations", rows)
    mem.store.append("revenue_events", mem.spark.createDataFrame([(1, "e", mem.tenant, "t", "sale", 1.0, 0.5, "s", "x", b)], tables.TABLES["revenue_events"]))
    assert mem.store.relations().count() == 1 and mem.store.revenue().first().entity_id == b
    mem.delete_entity("c", "b")
    assert mem.store.relations().count() == 0 and mem.store.revenue().first().entity_id is None


def test_versions_and_index_checks(mem, spark):
    assert mem.lint().count() == 0
    mem.set_entity("c", "a", {}), mem.search("a")
    assert mem.lint().count() == 0
    segment = mem.segments._state()[1]["segments"][0]["id"]
    spark.createDataFrame([], index._POSTINGS).write.mode("overwrite").partitionBy("tier").parquet(f"{mem.segments.root}/{segment}/postings")
    found = mem.lint().collect()
    assert [r.check for r in found] == ["fts-rowcount-mismatch"] and found[0].recovery
    mem.rebuild_index()
    assert mem.lint().count() == 0
    spark.createDataFrame([(9,)], "version int").write.mode("append").parquet(f"{mem.store.root}/_version")
    with pytest.raises(tables.SchemaError):
        memory.Memory(spark, mem.store.root)


def test_files_are_found_once(spark, tmp_path):
    (tmp_path / "a.db").write_bytes(b"12345")
    (tmp_path / "b.db").symlink_to(tmp_path / "a.db")
    found = tables.discovered(spark, [f"{tmp_path}/*.db", f"{tmp_path}/a.*", f"{tmp_path}/none"])
    assert found.count() == 1 and tables.total_size(found) == 5
    assert tables.total_size(tables.discovered(spark, [f"{tmp_path}/none"])) == 0
    found = tables.discovered(spark, [f"file://{tmp_path}/a.*", f"{tmp_path}/a.db", f"file://{tmp_path}/none*"])  # and in any file system
    assert found.count() == 1 and tables.total_size(found) == 5


def test_segments_merge_and_keep_figures(mem, monkeypatch):
    """Whatever came, was replaced and deleted, and however segments were merged: figures, ranks and substring hits are those of a new index."""
    monkeypatch.setattr(index, "FAN_IN", 2)
    r = random.Random(4)
    for step in range(4):
        rows = [("c", f"n{r.randrange(12)}", json.dumps({"t": " ".join(r.choices(["deploys", "red", "fox", "Bełżyce", "w1"], k=r.randrange(1, 9)))}, ensure_ascii=False)) for _ in range(7)]
        rows = list({x[:2]: x for x in rows}.values())
        mem.put_all("entities", mem.spark.createDataFrame(rows, "category string, name string, body string"))
        if step == 2:
            mem.delete_entity("c", rows[0][1]), mem.set_state("s", {"t": "red deploy"}), mem.set_state("s", {"t": "deploy twice, deploy"})
        mem.segments.refresh()
    n, state = mem.segments._state()
    levels = [s["level"] for s in state["segments"]]
    assert max(levels) >= 2 and len(levels) == len(set(levels))
    kept, live = mem.segments.index(), mem.store.live
    fresh = index.build(index.searchable(live("entities"), live("state_documents"), live("reference_documents"), live("journal_events")))
    assert sorted(map(tuple, kept.stats.collect())) == sorted(map(tuple, fresh.stats.collect()))
    assert sorted((x.tier, x.seq, x.term, x.tf, x.dl, x.pos) for x in kept.postings.collect()) == sorted((x.tier, x.seq, x.term, x.tf, x.dl, x.pos) for x in fresh.postings.collect())
    hits = lambda i, source: {(x.tier, x.seq): round(x["rank"], 9) for x in search.rank_substrings(source, ["deploy", "ełży"], None).collect()}
    assert hits(kept, kept.substrings()) == hits(fresh, fresh.substrings()) != {}
    # a search reads the postings of its words: the term is pushed to every segment, and nothing is counted
    plan = search.rank_words(kept, [["red"]], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.replace(" ", "").count("EqualTo(term,red)") >= len(levels)
    words = mem.segments._words(state).collect()
    assert len(words) == len({w.word for w in words})


def test_two_writers_of_one_state(mem):
    a, b = manifest.Manifest(mem.spark, f"{mem.store.root}/m", keep=2), manifest.Manifest(mem.spark, f"{mem.store.root}/m")
    assert a.read() == (0, {}) and a.commit(0, {"x": 1}) == 1
    with pytest.raises(tables.ConflictError):
        b.commit(0, {"x": 2})
    assert b.read() == (1, {"x": 1})
    for n in range(1, 5):
        a.commit(n, {"x": n})
    assert b.read() == (5, {"x": 4}) and len(a._numbers()) <= 3


@pytest.mark.parametrize("word", ["war", "die", "hat", "con", "son", "era", "ten", "can", "may"])
def test_words_that_mean_something_abstain(word):
    assert word not in search.FUNCTION_WORDS
    assert {"the", "nicht", "och", "para"} & search.FUNCTION_WORDS == {"the", "nicht", "para"}


def test_record_searches_in_one_plan(spark):
    rows = [(k, f"{k}-{i}", {"text": f"co{i:04d} topic{i % 2}alpha {k} words"}) for i in range(12) for k in ("report", "email")]
    made, folded = built(spark, rows)
    queries = ["co0007 topic1alpha", "co0003 report", "war archive", "the co0001 nicht", ""]
    many = search.search_records_many(made, folded, queries, limit=50).collect()
    got = {i: sorted(r.seq for r in many if r["query"] == i) for i in range(5)}
    assert got[0] == [15, 16] and got[2] == got[4] == [] and set(got[3]) == {3, 4} and got[1][:1] == [7]

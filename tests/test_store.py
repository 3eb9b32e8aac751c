import json
import random

import pytest
from pyspark.sql import functions as F

from tierlake.operators import documents, learn, lint, memory, shape
from tierlake.sources import tables
from tierlake.streaming import journal


@pytest.fixture
def mem(spark, tmp_path):
    return memory.Memory(spark, str(tmp_path / "store"))


def test_entities(mem):
    a = mem.set_entity("project", "x", {"members": ["a"], "score": 1.5}, status="open", ts="2024-01-01T00:00:00.000Z")
    b = mem.set_entity("project", "x", {"n": 2}, ts="2024-01-02T00:00:00.000Z")
    assert a["id"] == b["id"] and b["body"] == {"n": 2} and b["status"] is None
    assert (b["created_at"], b["updated_at"]) == ("2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z")
    assert mem.delete_entity("project", "x") and not mem.delete_entity("project", "x")
    with pytest.raises(tables.NotFoundError):
        mem.get_entity("project", "x")
    c = mem.set_entity("project", "x", {})
    assert c["id"] != a["id"] and c["created_at"] > "2024-01-02"
    out = mem.archive_entity("project", "x", "done")
    assert out["original_id"] == c["id"] and mem.recall("project", "x") is None
    with pytest.raises(tables.ValidationError):
        mem.set_entity("p", "y", "text")


def test_lists_state_references_events(mem):
    for i, (c, s) in enumerate((("a", "open"), ("a", "shut"), ("b", "open"))):
        mem.set_entity(c, f"n{i}", {}, status=s, ts=f"2024-01-0{i + 1}")
    assert [r["name"] for r in mem.list_entities().collect()] == ["n2", "n1", "n0"]
    assert mem.list_entities("a", "open").count() == 1 and mem.list_entities(status="open").count() == 2 and mem.list_entities(limit=-1).count() == 0
    assert mem.get_state("k") is None
    mem.set_state("k", {"v": 1}), mem.set_state("k", [2])
    assert mem.get_state("k") == [2]
    mem.set_reference("r", "plain"), mem.set_reference("s", {"a": 1}, {"m": 1})
    assert mem.get_reference("r") == "plain" and mem.get_reference("s") == '{"a":1}'
    for i in range(3):
        mem.write_event(acted=["x"], ts=f"2024-01-0{i + 1}")
    assert [r["ts"] for r in mem.read_events(since="2024-01-02").collect()] == ["2024-01-03", "2024-01-02"]
    other = memory.Memory(mem.spark, mem.store.root, tenant="other")
    assert other.read_events().count() == 0 and other.recall("a", "n0") is None
    assert mem.store.count_rows("entities", mem.tenant) == 3
    assert mem.store.payload_bytes(mem.tenant) > 0 and mem.search("plain").count() == 1


def test_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shape, "FREE_CAP", 10)
    monkeypatch.setattr(shape.write_allowed, "__defaults__", (10, False))
    with pytest.raises(tables.CapExceededError):
        memory.Memory(spark, str(tmp_path)).set_state("k", {"long": "x" * 50})
    memory.Memory(spark, str(tmp_path), paid=True).set_state("k", {"long": "x" * 50})


def test_document_store(mem):
    for ns, k, v in ((("a", "b"), "1", {"kind": "x", "score": 1}), (("a", "c"), "2", {"kind": "y", "score": 2}), (("a", "b", "d"), "3", {"kind": "x"}), (("e",), "4", {"kind": None})):
        mem.put(ns, k, v)
    found = lambda **o: sorted(r["key"] for r in mem.find(**o).collect())
    assert found(prefix=("a", "b")) == ["1", "3"] and found(prefix=()) == ["1", "2", "3", "4"]
    assert found(filter={"kind": "x"}) == ["1", "3"] and found(filter={"score": {"$gte": 1, "$lt": 2}}) == ["1"]
    assert found(filter={"score": {"$ne": 1}}) == ["2", "3", "4"] and found(filter={"kind": None}) == ["4"]
    assert mem.find(limit=1, offset=3).count() == 1
    names = lambda **o: ["/".join(r[0]) for r in mem.namespaces(**o).collect()]
    assert names() == ["a/b", "a/b/d", "a/c", "e"] and names(max_depth=1) == ["a", "e"] and names(prefix=("a", "*")) == ["a/b", "a/b/d", "a/c"] and names(suffix=("d",)) == ["a/b/d"]
    mem.put(("e",), "4", None)
    assert mem.get(("e",), "4") is None and mem.get(("a", "b"), "1")["body"] == {"kind": "x", "score": 1}
    for bad in ({"a": {"$near": 1}}, {"a": {"$in": 3}}):
        with pytest.raises(ValueError):
            documents.compile_filter(F.col("body"), bad)
    for ns in ((), ("a/b",), ("",), ("..",)):
        with pytest.raises(tables.ValidationError):
            mem.put(ns, "k", {})
    with pytest.raises(ValueError):
        mem.namespaces(max_depth=-1)
    with pytest.raises(tables.ValidationError):
        documents.checked_value({1: 2})


FILTERS = [
    ({"n": {"$gt": 1}}, {2}), ({"n": {"$lte": 1.0}}, {0, 1}), ({"n": True}, {0, 1}), ({"n": 1.0}, {0, 1}), ({"s": {"$gt": "b"}}, {3}), ({"s": {"$gt": 1}}, set()),
    ({"n": {"$in": [2, None]}}, {2, 3, 4}), ({"n": {"$nin": [1]}}, {2, 3, 4}), ({"s": {"$in": "a c"}}, {3}), ({"o": {"k": [1]}}, {4}), ({}, {0, 1, 2, 3, 4}), ({"o": {}}, set()),
]


@pytest.mark.parametrize("spec,want", FILTERS)
def test_filters(spark, spec, want):
    values = [{"n": 1}, {"n": True}, {"n": 2}, {"s": "c"}, {"o": {"k": [1]}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, body string")
    assert {r.i for r in df.where(documents.compile_filter(F.col("body"), spec)).collect()} == want


@pytest.mark.parametrize(
    "spec,want",
    [({"a'b": 1}, {0}), ({'a"b': 1}, {1}), ({"a'\"b": 1}, {2}), ({"a.b": {"$gte": 1}}, {3}), ({"big": 9007199254740993}, {4}), ({"big": {"$gt": 9007199254740992}}, {4}), ({"big": 9007199254740992.0}, {5}), ({"n": {"$lt": 1.5}}, {6}), ({"n": 1.0}, {6}), ({"n": {"$ne": None}}, {6})],
)
def test_filters_of_any_name_and_size(spark, spec, want):
    values = [{"a'b": 1}, {'a"b': 1}, {"a'\"b": 1}, {"a.b": 1}, {"big": 9007199254740993}, {"big": 9007199254740992}, {"n": 1}, {"n": None}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, body string")
    assert {r.i for r in df.where(documents.compile_filter(F.col("body"), spec)).collect()} == want


def events(spark, rows):
    data = [(i + 1, f"e{i}", "t", ts, None if e is None else json.dumps(e), None if a is None else json.dumps(a), None, None) for i, (ts, e, a) in enumerate(rows)]
    return spark.createDataFrame(data, tables.TABLES["journal_events"])


def test_signatures(spark):
    cases = [(["Deploy staging now please"], "deploy-staging-now"), ([{"kind": "", "action": "Run it"}], "run-it"), ({"type": "Ship"}, "ship"), ("Say hello", "say-hello"), ([], None), ({}, None), ([1], None), (None, None)]
    df = events(spark, [("2024", None, a) for a, _ in cases])
    assert [r[0] for r in df.orderBy("seq").select(learn.signature(F.col("acted"))).collect()] == [w for _, w in cases]


def test_tokens(spark):
    df = events(spark, [("2024", {"module": 1, "owner": 2}, ["deploy staging"])])
    assert sorted(df.select(learn.tokens()).first()[0]) == ["deploy-staging", "module", "owner"]


def test_learning_passes(mem):
    for i in range(4):
        mem.write_event(evaluated={"task": "t", "ticket": i}, acted=["deploy staging"], ts=f"2024-01-0{i + 1}T00:00:00.000Z")
    got = {r.slug: r.confidence for r in mem.learn().collect()}
    assert abs(got["repeat-deploy-staging"] - 0.6) < 1e-9 and "routine-deploy-staging" in got and "pair-task-ticket" in got
    assert mem.learn().count() == 0
    runs = mem.store.scan("learning_runs").orderBy("seq").collect()
    assert [r.events_scanned for r in runs] == [4, 0] and runs[1].cursor_after_seq == 4
    rows = mem.store.scan("skill_proposals")
    first = learn.list_proposals(rows).first()
    done, refs = learn.review(rows, first["id"], True, "2024-02-01")
    assert done.first()["status"] == "accepted" and refs.first()["doc_key"] == f"skill/{first['proposed_slug']}"
    none, no_refs = learn.review(done, first["id"], True, "2024-02-01")
    assert none.count() == no_refs.count() == 0
    events = mem.store.scan("journal_events")
    assert learn.all_evidence(events, learn.propose(events).where("pattern_kind = 'repeated_action'")).count() == 1


def test_lint(mem):
    mem.set_entity("a", "same", {}, ts="2020-01-01T00:00:00.000Z"), mem.set_entity("b", "same", {})
    mem.set_reference("blank", " "), mem.write_event()
    found = {r["check"]: r for r in mem.lint().collect()}
    assert set(found) == {"duplicate-entity", "stale-entity", "empty-reference", "journal-without-acts"}
    text = lint.report([r.asDict() for r in found.values()])
    assert text.startswith("OK: 0 critical, 2 warning, 2 info")
    bad = mem.spark.createDataFrame([(1, '{"a":1} x'), (2, '{"a":1,"a":2}'), (3, "NaN"), (4, '{"a":'), (5, None)], "seq int, body string")
    assert [r.detail for r in lint.invalid_json(bad, "c", F.col("seq"), ["body"]).collect()] == ["1", "3", "4"]


def test_turns_and_budget(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "user", "q2"), (1, 2, "system", "s"), (1, 3, "assistant", "a2"), (1, 4, "assistant", "a3"), (1, 5, "user", "  "), (1, 6, "assistant", "a4")]
    got = shape.paired_turns(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    assert [(r.user_turn, r.turn) for r in got] == [(1, 3)]
    hits = spark.createDataFrame([(i, "x" * 50) for i in range(5)], "i int, body string")
    assert shape.bounded(hits, [F.col("i")], each=40, total=100).count() == 2 and shape.bounded(hits, [F.col("i")], each=40, total=1).count() == 1


def test_streams(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = events(spark, [(f"2024-01-01T00:0{i}:00.000Z", None, ["ping host"]) for i in range(4)])
    rows.write.parquet(path)
    for n in (1, 1):  # the second run finds nothing new
        journal.mine(journal.read_journal(spark, path), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert "repeat-ping-host" in {r.slug for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    counts = journal.action_counts(journal.read_journal(spark, path)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [4]


def test_files_and_credentials(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"tenant_id": " ", "account_id": "acc"}')
    assert tables.credentials(spark, str(tmp_path / "c.json")).first()[0] == "acc"
    assert tables.stored_files(spark, str(tmp_path)).count() == 1


def test_stream_of_files_equals_one_batch(spark, tmp_path):
    """However events are dealt out to files, late ones included, the proposals are those of all of them."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        minute = i * 17 if i % 9 else i * 17 - 300  # some come late
        ts = f"2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00.000Z" if minute >= 0 else None
        rows.append((i + 1, f"e{i}", "t", ts, json.dumps({"task": i, f"k{i % 3}": 1}), json.dumps([["deploy staging", "run tests", "send mail"][r.randrange(3)]]), None, None))
    schema = tables.TABLES["journal_events"]
    found = []
    for name, size in (("one", 60), ("many", 7)):
        path, out = str(tmp_path / name / "journal"), str(tmp_path / name / "out")
        for at in range(0, 60, size):
            spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(path)
        journal.mine(journal.read_journal(spark, path, 1), out, str(tmp_path / name / "check")).awaitTermination()
        last = max(int(p.name[6:]) for p in (tmp_path / name / "out").glob("batch=*"))
        assert last == (0 if size == 60 else 8)
        found.append(sorted((x.pattern_kind, x.slug, round(x.confidence, 9), x.hits, x.detail, x.first_seq) for x in spark.read.parquet(f"{out}/batch={last}").collect()))
    batch = learn.propose(spark.createDataFrame(rows, schema))
    assert found[0] == found[1] == sorted((x.pattern_kind, x.slug, round(x.confidence, 9), x.hits, x.detail, x.first_seq) for x in batch.collect()) != []


def test_frequent_pairs_in_two_passes(spark):
    r = random.Random(2)
    rows = [(i, json.dumps([f"word{r.randrange(400)}" for _ in range(12)] + ["often seen", "with this"] * (i % 4 == 0)), None) for i in range(200)]
    events = spark.createDataFrame(rows, "seq long, evaluated string, acted string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = learn.co_occurrence(events, 4)
    for buckets in (8, 1 << 16):
        assert plain(learn.co_occurrence(events, 4, buckets)) == plain(want) != []
    every, kept = learn.pairs_of(events).count(), learn.frequent_pairs(events, 4, 1 << 16).count()
    assert kept < every / 10, f"{kept} of {every} pairs"


def test_snapshots_have_the_live_rows_of_the_log(mem, spark, monkeypatch):
    """Whatever is compacted when: live rows, their birth and ids are those of the whole log, and a point read opens few files."""
    r = random.Random(9)
    for step in range(5):
        for _ in range(4):
            name = f"n{r.randrange(5)}"
            if r.random() < 0.3:
                mem.delete_entity("c", name)
            else:
                mem._add("entities", op="put", id=f"i{step}{r.random()}", category="c", name=name, body=json.dumps({"x": r.random()}), ts=f"2024-01-0{step + 1}T00:00:00.000Z")
        if step in (1, 2, 3):
            mem.store.compact("entities")
    log = mem.store.scan("entities")
    want = sorted(map(tuple, tables.latest(log, tables.KEYS["entities"]).select("category", "name", "id", "body", "created_at", "updated_at", "seq").collect()))
    assert sorted(map(tuple, mem.store.live("entities").select("category", "name", "id", "body", "created_at", "updated_at", "seq").collect())) == want != []
    for row in want:
        assert mem.store.one("entities", mem.tenant, category="c", name=row[1]).seq == row[6]
    assert mem.recall("c", "nobody") is None and mem.store.next_seq("entities") == log.agg(F.max("seq")).first()[0] + 1
    own = mem.store._of(mem.store._state()[1], "entities")
    assert len(own["old"]) == 3 and own["parts"] == []
    mem.write_event(acted=["a b"]), mem.store.compact("journal_events"), mem.write_event(acted=["c d"]), mem.store.compact("journal_events")
    assert mem.read_events().count() == 2 and len(mem.store._of(mem.store._state()[1], "journal_events")["parts"]) == 1
    monkeypatch.setattr(memory, "COMPACT_EVERY", 2)
    before = mem.store.version()
    mem.set_state("k", {"a": 1}), mem.set_state("k", {"a": 2})
    assert mem.store.version() > before and mem.get_state("k") == {"a": 2}


def test_archive_is_all_or_nothing(mem, monkeypatch):
    mem.set_entity("c", "a", {"x": 1})
    real = mem.store._written

    def cut_off(table, rows, folder):
        if table == "entities" and folder.startswith("_parts"):
            raise OSError("the cluster went away")
        real(table, rows, folder)

    monkeypatch.setattr(mem.store, "_written", cut_off)
    with pytest.raises(OSError):
        mem.archive_entity("c", "a")
    assert mem.store.scan("archived_entities").count() == 0 and mem.recall("c", "a")
    monkeypatch.setattr(mem.store, "_written", real)
    version = mem.store.version()
    mem.archive_entity("c", "a", "old")
    assert mem.recall("c", "a") is None and mem.store.scan("archived_entities").count() == 1
    with pytest.raises(tables.ConflictError):  # another writer's rows were made from the state before
        mem.store.commit({"entities": mem.store.scan("entities").limit(0)}, version)


def test_filter_parses_a_body_once(spark):
    from tierlake.operators import documents

    spec = {"a": {"$in": [1, 2.0, "3"], "$ne": None}, "b": {"$gt": 1, "$lt": 9}}
    rows = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": "3", "b": 8.5}',), ('{"a": 3, "b": 2}',), ('{"a": 2, "b": 9}',), ("{",), (None,)], "body string")
    found = rows.where(documents.compile_filter(rows.body, spec))
    assert [r.body for r in found.collect()] == ['{"a": 1, "b": 2}', '{"a": "3", "b": 8.5}']
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def test_archive_finds_its_rows_once(spark, tmp_path, monkeypatch):
    from tierlake.sources.tables import Store

    store, plans = Store(spark, str(tmp_path / "s")), []
    real = store.commit
    monkeypatch.setattr(store, "commit", lambda rows, after: plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in rows.values()) or real(rows, after))
    put = spark.createDataFrame([(i, "put", f"i{i}", "t", "c", f"n{i}", "F" if i % 2 else "O", "{}", "2024") for i in range(6)], "seq long, op string, id string, tenant_id string, category string, name string, status string, body string, ts string")
    store.append("entities", put)
    assert store.archive(store.live("entities").where("status = 'X'"), "2024-02") == 0
    assert store.archive(store.live("entities").where("status = 'F'"), "2024-02") == 3
    assert {r.name for r in store.live("entities").collect()} == {"n0", "n2", "n4"} and store.scan("archived_entities").count() == 3
    assert "first" not in plans[3] and "Join" not in plans[3] and not list((tmp_path / "s" / "_moving").glob("*"))

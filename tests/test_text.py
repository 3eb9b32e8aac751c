import sqlite3

import pytest
from pyspark.sql import functions as F

from tierlake.functions import porter, text as tx
from tierlake.operators import lint
from tierlake.sources import tables


def test_query_tokens():
    assert tx.query_tokens('  foo-bar AND "baz" snake_case ') == ["foo", "bar", "baz", "snake_case"]
    assert tx.query_tokens("and or") == ["and", "or"] and tx.query_tokens("and or", prefix=True) == []
    assert tx.query_tokens("!!!") == [] and len(tx.query_tokens("a " * 5000)) == 2048


def test_relaxed_queries():
    assert tx.relaxed_queries("what is the deployment status") == [["deployment", "status"], ["deployment"], ["status"]]
    assert tx.relaxed_queries("single") == [] and tx.relaxed_queries("x k8 us") == [["x", "k8"], ["k8"]]


def test_stems_and_folds():
    assert [tx.stem(w) for w in ("reklamacja", "status", "abc", "v2beta1", "sześciu")] == ["reklama", "statu", "abc", "v2beta1", "sześc"]
    assert tx.fold("ŁÓDŹ straße Æon") == "lÓdŹ strasse aeon"
    assert tx.slug("  Hello, World! -- x ") == "hello-world-x" and tx.slug("!!") == "untitled"


def test_limits():
    assert [tx.clamp_limit(x) for x in (5, -3, 10**9, "x", None, "7")] == [5, 0, 10_000, 0, 0, 7]
    assert tx.clamp_page(None, -2) == (10, 0) and tx.clamp_page(-1, 3) == (0, 3)


@pytest.mark.parametrize("tokens,text,bucket", [(["a"], "x", 0), (["red", "fox"], "the red fox", 0), (["red", "fox"], "fox and red", 1), (["red", "fox"], "red a b c d e f fox", 2), (["red", "fox"], "red", 2), (["ed", "fo"], "red fox", 2), (["red", "red"], "red x", 1)])
def test_proximity(spark, tokens, text, bucket):
    from pyspark.sql import functions as F

    assert tx.proximity(tokens, text) == bucket
    assert spark.createDataFrame([(text,)], "t string").select(tx.proximity_col(tokens, F.col("t"))).first()[0] == bucket


def test_column_twins(spark):
    from pyspark.sql import functions as F

    values = ["ŁÓDŹ Straße", "running-Fast 99 bottles", "", "reklamacja", "  A--b!!c ", "Œuvre ß"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = df.select("t", tx.fold_col(F.col("t")).alias("f"), tx.stem_col(F.col("t")).alias("s"), tx.slug_col(F.col("t")).alias("g"), tx.normalized_col(F.col("t")).alias("n")).collect()
    for r in got:
        assert (r.f, r.s, r.g, r.n) == (tx.fold(r.t), tx.stem(r.t), tx.slug(r.t), tx.normalized(r.t))


def test_porter_terms_match_a_full_text_table():
    words = "running runs ponies caresses cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll café naïve snake_case v2".split()
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text tables here")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert sorted(r[0] for r in con.execute("SELECT term FROM v")) == sorted(set(porter.terms(w))), w


def test_identifiers():
    for bad in ("", None, "a..b", "a<b", "a\nb", "x" * 1025, "a;b", 'a"b', "a`b"):
        with pytest.raises(tables.ValidationError):
            tables.valid_identifier(bad)
    assert tables.valid_identifier("a/b\\c'd") == "a/b\\c'd"
    assert tables.tenant_of(" ", "acc") == "acc" and tables.tenant_of(None, None) == tables.DEFAULT_TENANT


def test_json_is_checked_in_python_where_in_doubt(spark):
    texts = ['{"a": 1}', "[]", "1", '"x"', "null", "true", " 1.5e3 \n", '{"a":1,"a":2}', '{"a":{"a":1}}', "[" * 60 + "]" * 60, '"é😀\\u00e9"', "-0"]
    wrong = ["", " ", "{", "{} x", "1, 2", "1],[2", "1] }", "1}", '1,"b":2', '1}, {"a":2', "NaN", "[Infinity]", "01", "'x'", "{a:1}", "[1,]", "// x\n1", '"a\nb"', "\ufeff1", "tru", "1 1", "[" * 100_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *wrong, None])], "seq long, body string")
    found = lint.invalid_json(rows, "check", F.col("seq"), ["body"], 1000)
    assert [int(r.detail) for r in found.collect()] == [*range(len(texts), len(texts) + len(wrong))]
    sure = rows.where(~lint.json_doubtful(F.col("body"))).collect()
    assert {r.body for r in sure} == {*texts, None} - {'{"a":1,"a":2}'}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("try_parse_json" if "try_parse_json" in plan else "parse")

r"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed, and from the literals in it follows a Boolean trigram
query: where the expression demands one of several strings, a matching text holds all trigrams of
one of them. The index has a posting (trigram, document) for the trigrams that rules ask
for; intersecting a document's postings answers every query, and only documents that satisfy a
rule's query are verified with its regular expression. A rule whose expression has no mandatory
trigram cannot be answered from the index and scans every document.

Matches are found with their positions: splitting a text at a pattern gives what lies between the
matches, so the lengths of these pieces and of the matches, summed, are the offsets. Java's
expressions take the same leftmost matches as other backtracking engines; `length` counts code points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from re import IGNORECASE, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Strings that a part of an expression may stand for before it counts as open, and members of a character class.
MOST_STRINGS, MOST_MEMBERS = 64, 8
#: Matches of a text whose places are summed up in one step; more are taken in blocks, so that no array is copied for each match.
MATCHES = 512


def _strings(item: tuple, folded: bool) -> set[str] | None:
    """The strings that one item of a parsed expression stands for, in lower case if case is folded; None if they are open."""
    kind, value = str(item[0]), item[1]
    own = lambda c: chr(c).lower() if folded else chr(c)
    if kind == "LITERAL":
        return {own(value)} if value < 128 or not folded else None
    if kind == "IN":
        members: set[str] = set()
        for what, x in value:
            if str(what) == "LITERAL":
                members.add(own(x))
            elif str(what) == "RANGE" and x[1] - x[0] < MOST_MEMBERS:
                members |= {own(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return members if len(members) <= MOST_MEMBERS else None
    if kind == "SUBPATTERN":
        return _sequence(value[3], (folded or bool(value[1] & IGNORECASE)) and not value[2] & IGNORECASE)[0]
    if kind == "BRANCH":
        options = [_sequence(branch, folded)[0] for branch in value[1]]
        return None if None in options else set().union(*options)
    if kind == "MAX_REPEAT" and value[1] == 1:
        inner = _sequence(value[2], folded)[0]
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _grams(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def _demands(item: tuple, folded: bool) -> list[list[list[str]]]:
    """What an open item still demands of a match."""
    kind, value = str(item[0]), item[1]
    if kind == "SUBPATTERN":
        return _sequence(value[3], (folded or bool(value[1] & IGNORECASE)) and not value[2] & IGNORECASE)[1]
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
        return _sequence(value[2], folded)[1]
    if kind == "BRANCH":
        # of each branch what it demands without a choice
        options = [[t for clause in _sequence(branch, folded)[1] if len(clause) == 1 for t in clause[0]] for branch in value[1]]
        return [options] if all(options) else []
    return []


def _sequence(items, folded: bool) -> tuple[set[str] | None, list[list[list[str]]]]:
    """Of a sequence of items the strings that it stands for, or None, and its clauses: of each some option's trigrams are all there."""
    now, clauses, whole = {""}, [], True

    def close() -> None:
        options = [_grams(x) for x in sorted(now)]
        if all(options):  # an option that demands more than another one adds nothing
            clauses.append([o for i, o in enumerate(options) if not any(set(p) < set(o) or set(p) == set(o) and j < i for j, p in enumerate(options))])

    for item in items:
        found = _strings(item, folded)
        if found is not None and len(now) * len(found) <= MOST_STRINGS:
            now = {a + b for a in now for b in found}
            continue
        close()
        whole, now = False, {""} if found is None else found
        if found is None:
            clauses += _demands(item, folded)
    close()
    return now if whole else None, clauses


@lru_cache(maxsize=1024)
def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Conjunction of disjunctions of conjunctions of trigrams that every match of the expression satisfies; empty: none is mandatory."""
    return _sequence(_parser.parse(pattern), False)[1]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters that `group` must have, else the match is dropped
    group: int = 0
    base: bool = True
    gate: str = field(default="")  # a plainer expression that every kept match satisfies

    def query(self) -> list[list[list[str]]]:
        return trigram_query(self.pattern)


#: The three base kinds in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, gate=r"[0-9a-f]{32}"),
)
#: Spans that this method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, base=False),
)
RULES = BASE + MORE


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for, ASCII letters in lower case."""
    return sorted({t.lower() for r in rules for clause in r.query() for option in clause for t in option})


def postings(docs: DataFrame, rules: tuple[Rule, ...], key: Column, text: Column) -> DataFrame:
    """(key, trigram): the inverted index, for the trigrams in the rules' vocabulary.

    Letters are folded, so it holds for either case; verification tells the cases apart.
    """
    words = vocabulary(rules)
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(i)) for i, t in enumerate(words)])
    rows = docs.select(key.alias("key"), lower.alias("lower"))
    return rows.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, verify): of each document that satisfies a query the numbers of the rules to verify.

    A document's postings meet as bit masks of 63 trigrams each, summed up before the shuffle.
    """
    number = {t: i for i, t in enumerate(vocabulary(rules))}
    parts = range(max(1, -(-len(number) // 63)))
    masks = index.groupBy("key").agg(*[F.expr(f"bit_or(if(trigram div 63 = {p}, shiftleft(1L, trigram % 63), 0L))").alias(f"m{p}") for p in parts])

    def holds(option: list[str]) -> Column:
        out, held = F.lit(True), {number[t.lower()] for t in option}
        for p in parts:
            asked = sum(1 << i % 63 for i in held if i // 63 == p)
            if asked:
                out = out & (F.col(f"m{p}").bitwiseAND(F.lit(asked)) == asked)
        return out

    def satisfies(rule: Rule) -> Column:
        out = F.lit(True)
        for clause in rule.query():
            some = F.lit(False)
            for option in clause:
                some = some | holds(option)
            out = out & some
        return out

    found = F.array_compact(F.array(*[F.when(satisfies(r), F.lit(i)) for i, r in enumerate(rules) if r.query()], F.lit(None).cast("int")))
    return masks.select("key", found.alias("verify")).where(F.size("verify") > 0)


def spans_of(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start,kind,end>> of the rule's kept matches, offsets in code points, in order.

    start comes first so that arrays of several rules sort by start, then by the rules' order.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    graded = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.arrays_zip(whole.alias("match"), graded.alias("graded")), F.slice(between, F.lit(1), F.size(whole)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["match"]).alias("n"), F.length(m["graded"]).alias("graded")))
    kind = "struct<start:int,kind:int,end:int>"
    none = F.array().cast(f"array<{kind}>")

    def placed(acc: Column, r: Column) -> Column:
        # each match begins where the one before ended
        start = acc["at"] + r["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + r["n"]).alias("end"))
        return F.struct((start + r["n"]).alias("at"), F.when(r["graded"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), placed)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    # the matches are bound to a name, so that they are found once
    cut = lambda found: F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / MATCHES).cast("int")), lambda i: F.slice(found, i * MATCHES + 1, MATCHES))
    blocks = F.transform(F.array(rows), cut)[0]
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda acc: acc["out"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with column secret_spans: array<struct<start,kind,end>> sorted by start, then rule.

    ``kind`` is the rule's number. A null text counts as empty and has no spans. Rows of one id
    share their postings, so one of them may be verified in vain; null ids, which no posting can
    point to, are verified by every rule. A column named secret_spans is replaced, other columns
    stay; an empty table gives an empty table.
    """
    found = _scanned(docs, rules, id_col, text_col)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "secret_spans"], "secret_spans")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(row, secret_spans): whole rows under one name, so that no column of theirs can clash."""
    # rows of null id have no partner; by their own hash they do not all go to one task
    spread = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int")
    inner = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"), text_of(text_col).alias("text")).withColumn("spread", spread)
    index = postings(docs.where(F.col(id_col).isNotNull()), rules, F.col(id_col), text_of(text_col))
    joined = inner.join(candidates(index, rules).withColumn("spread", F.lit(0)), ["key", "spread"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, r in enumerate(rules):
        if r.query():
            ask = F.col("key").isNull() | F.coalesce(F.array_contains("verify", i), F.lit(False))
        else:
            ask = F.rlike(F.col("text"), F.lit(r.gate)) if r.gate else F.lit(True)
        found.append(F.when(ask, spans_of(F.col("text"), i, r)).otherwise(none))
    spans = F.array_sort(F.concat(*found))
    return joined.select("row", spans.alias("secret_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, the same columns, with every found span replaced by the mark, overlapping spans by one; a null text stays null.

    The pieces of a text between its spans are gathered in blocks and joined once.
    """
    text = F.col(f"row.`{text_col}`")
    kind = "struct<at:int,out:array<string>>"
    none = F.array().cast("array<string>")

    def cut(acc: Column, s: Column) -> Column:
        # what lies between the spans so far and this one; a span that begins inside them adds nothing
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out")).cast(kind)

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")).cast(kind), cut)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("secret_spans") - 1) / MATCHES).cast("int")), lambda i: F.slice("secret_spans", i * MATCHES + 1, MATCHES))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))
    end = lambda acc: F.array_join(F.concat(F.flatten(acc["out"]), F.array(F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))), mark)
    clean = F.when(F.size("secret_spans") > 0, F.aggregate(blocks, start, block, end)).otherwise(text)
    found = _scanned(docs, rules, id_col, text_col)
    return found.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base, RULES), 256).alias("base_sha256"), listed(F.col("secret_spans"), RULES).alias("spans"),
    )


def _sql(rules: tuple[Rule, ...]) -> str:
    """The query in SQL, over every rule and text alike."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    matches = "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, {quoted(r.kind)} AS name, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}) AS m, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS b FROM d"
        for i, r in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({matches}),
u AS (SELECT doc_id, kind, name, least, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
s AS (SELECT doc_id, kind, name, length(g) >= least AS keep, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
k AS (SELECT doc_id, kind, stop - n AS start, name || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS x FROM s WHERE keep),
z AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(x, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY start, kind) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)
"""


ORACLE_SQL = {"op6_secrets": _sql(RULES)}

"""A Merkle manifest of a table: a digest per row, trees per group of rows, and one root.

Levels are windows: the nodes of a group are numbered, a window partitioned by group and parent
number, ordered and framed in full, lists the digests of a run. The list is the parent's preimage
and has each node's siblings, so one window serves both the way up and the proofs. Parents are
deduplicated before the next level. No window holds more than ``fan_out`` nodes, whatever the size
of the group.

Numbers come from ranges: rows are range-partitioned by group and order, written with their range,
numbered inside it, and moved on by the sizes of the ranges before. A group that holds most rows
lies in many ranges. On the way down every node takes its parent's path behind its own siblings, by a
join on (group, parent number), which meets at most ``fan_out`` rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, partitions, saved, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node's siblings in its run: the digests before it and after it, joined.
STEP = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of one row's values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def proof(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with i, the place in its group ``g`` by ``order`` from 0, and n, the size of the group."""
    cut = rows.repartitionByRange(partitions(rows.sparkSession), "g", *order).withColumn("part", F.spark_partition_id())
    cut = saved(cut, "merkle-ranges")
    parts = Window.partitionBy("g").orderBy("part")  # a row for each range of the group
    sizes = cut.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(parts.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = sizes.withColumn("n", F.sum("size").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    found = cut.withColumn("place", place).join(sizes.drop("size"), ["g", "part"])
    found = saved(found.withColumn("i", F.coalesce("before", F.lit(0)) + F.col("place")).drop("part", "place", "before"), "merkle-leaves")
    dropped(cut)
    return found


def _climb(nodes: DataFrame, fan_out: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of each level the nodes with their runs, and the nodes that have no parent; at the lowest with all their columns."""
    runs, tops = [], []
    frame = Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        tops.append(nodes.where("n = 1"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return runs, tops
        run = nodes.withColumn("parent", F.floor(F.col("i") / fan_out)).withColumn("run", F.collect_list("digest").over(frame))
        runs.append(run)
        up = run.select("g", F.col("parent").alias("i"), F.ceil(F.col("n") / fan_out).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("digest"))
        nodes = saved(up.dropDuplicates(["g", "i"]), "merkle-level")


def _descend(runs: list[DataFrame], tops: list[DataFrame], above: DataFrame | None, fan_out: int, carried: list[str]) -> DataFrame:
    """The rows of the lowest level, ``carried`` columns of theirs, with the digest of their top and their whole path; ``above``: (g, path) of the tops.

    Paths are only shuffled to the nodes below, one for each run of them.
    """
    none = F.array().cast(STEP)

    def ends(level: int) -> DataFrame:
        named = tops[level].select("g", "i", F.col("digest").alias("top"), *(carried if level == 0 else []))
        return named.withColumn("path", none) if above is None else named.join(above, "g")

    at = ends(len(runs))
    for level in range(len(runs) - 1, -1, -1):
        own = F.pmod(F.col("i"), F.lit(fan_out)).cast("int")
        before, after = F.slice("run", F.lit(1), own), F.slice("run", own + 2, F.lit(fan_out))
        step = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
        higher = at.select("g", F.col("i").alias("parent"), "top", F.col("path").alias("higher"))
        found = runs[level].join(higher, ["g", "parent"])
        found = found.select("g", "i", "top", F.concat(F.array(step), "higher").alias("path"), *(carried if level == 0 else []))
        at = found.unionByName(ends(level))
    return at


def manifest(
    docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, fan_out: int = 16, claims: dict[str, Column] | None = None
) -> DataFrame:
    """One row for each row of ``docs``: group, order (named so), leaf, subroot, root, path and the ``claims``.

    Leaves are digests of ``fields``. Per group they ascend by ``order``, null first, equal ones by
    leaf; equal rows are leaves of their own. While several nodes remain, every ``fan_out``
    consecutive ones, the last run as many as are left, become the digest of their digests; what
    remains is the subroot, a lone leaf itself. The subroots, by group (null first, then by UTF-8
    bytes), give the root likewise. ``path`` is an array of (before, after), the siblings of each
    level, from the leaf to the root: ``proof`` joins them, ``fold`` goes up from any leaf.
    ``claims`` are columns computed from ``docs`` and carried along, such as the leaf of another
    version of the row. Texts are hashed whole, and only digests are shuffled. Other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    claims = claims or {}
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    carried = [value.alias(f"claim{i}") for i, value in enumerate(claims.values())]
    rows = docs.select(
        key.alias("g"), F.col(group).alias("group"), F.col(order).alias("id"), leaf(*[F.col(f) for f in fields]).alias("digest"),
        *carried, F.monotonically_increasing_id().alias("tie"),
    )
    # written first, so that ties are the same whenever they are read
    rows = saved(rows, "merkle-rows")
    leaves = _numbered(rows, ["id", "digest", "tie"])
    dropped(rows)
    runs, tops = _climb(leaves, fan_out)
    subs = tops[0].select("g", "digest")
    for top in tops[1:]:
        subs = subs.unionByName(top.select("g", "digest"))
    subs = _numbered(subs.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), ["of"])
    sub_runs, sub_tops = _climb(subs, fan_out)
    last = sub_tops[len(sub_runs)].first()
    root = F.lit(last["digest"] if last else None).cast("string")
    above = saved(_descend(sub_runs, sub_tops, None, fan_out, ["of"]).select(F.col("of").alias("g"), "path"), "merkle-subroots")
    carried = ["group", "id", "digest", *[f"claim{i}" for i in range(len(claims))]]
    found = _descend(runs, tops, above, fan_out, carried)
    out = [F.col("group").alias(group), F.col("id").alias(order), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path"]
    return found.select(*out, *[F.col(f"claim{i}").alias(name) for i, name in enumerate(claims)])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what folds from tampered texts; a row of null id is not tampered."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(touched, leaf(*[lower if f == "text" else F.col(f) for f in FIELDS]))
    made = manifest(table(spark, sf_dir, "documents"), claims={"claim": claim})
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, bit by bit."""
    bit = "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {byte}), 4294967295)"


def _sql(levels: int = 6, fan_out: int = 16) -> str:
    """The query in SQL: a fixed number of levels, enough for fan_out ** levels documents of a source."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""r AS MATERIALIZED (SELECT coalesce('+' || source, '') AS g, doc_id, {digest("text")} AS leaf,
  CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {digest(lower)} END AS claim FROM documents)""",
        """l0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
  leaf AS digest, doc_id, leaf, claim FROM r)""",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}r{k} AS MATERIALIZED (SELECT g, i, n, list(digest) OVER (PARTITION BY g, i // {fan_out} ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}{k} WHERE n > 1)""")
            parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT DISTINCT g, i // {fan_out} AS i, (n + {fan_out - 1}) // {fan_out} AS n, sha256(array_to_string(run, '')) AS digest FROM {name}r{k})""")

    def descend(name: str, above: str) -> None:
        top = f"SELECT t.g, t.i, t.digest AS top, {above} AS path FROM {name}{{k}} t {'' if above == '[]' else 'JOIN sd0 s ON s.digest_of = t.g'} WHERE t.n = 1"
        parts.append(f"{name}d{levels} AS MATERIALIZED ({top.format(k=levels)})")
        for k in range(levels - 1, -1, -1):
            own = f"[array_to_string(run[1:x.i % {fan_out}], '')] || [array_to_string(run[x.i % {fan_out} + 2:], '')]"
            parts.append(f"""{name}d{k} AS MATERIALIZED (SELECT x.g, x.i, top, [{own}] || path AS path FROM {name}r{k} x JOIN {name}d{k + 1} y ON x.g = y.g AND x.i // {fan_out} = y.i
  UNION ALL {top.format(k=k)})""")

    climb("l")
    tops = " UNION ALL ".join(f"SELECT g, digest FROM l{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"s0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, digest, g AS digest_of FROM ({tops}))")
    climb("s")
    descend("s", "[]")
    parts[-1] = parts[-1].replace("sd0 AS", "sp AS")
    parts.append("sd0 AS MATERIALIZED (SELECT s0.digest_of, sp.path, sp.top AS root FROM s0 JOIN sp USING (g, i))")
    descend("l", "s.path")
    return f"""
WITH {", ".join(parts)},
f AS (SELECT l0.doc_id, l0.leaf, d.top AS subroot, s.root, sha256(array_to_string(flatten(d.path), '')) AS proof_sha256,
  list_reduce(list_prepend([coalesce(l0.claim, l0.leaf)], d.path), lambda acc, s: [sha256(s[1] || acc[1] || s[2])])[1] AS folded_root
  FROM l0 JOIN ld0 d USING (g, i) JOIN sd0 s ON s.digest_of = l0.g)
SELECT *, folded_root = root AS verified FROM f
"""


ORACLE_SQL = {"op11_merkle": _sql()}

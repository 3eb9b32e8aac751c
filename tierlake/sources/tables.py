"""The tiered data model and its storage: immutable logs of rows, read as the latest row per key."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed values of the data model.
DEFAULT_TENANT = "00000000-0000-0000-0000-000000000001"
SCHEMA_VERSION = 4
MAX_IDENTIFIER, MAX_BODY_BYTES, FREE_CAP = 1024, 1 << 20, 5 << 20
_FORBIDDEN = set('<>|;"`')


class TierlakeError(Exception):
    """Base of the errors below."""


class ValidationError(TierlakeError, ValueError):
    pass


class NotFoundError(TierlakeError, LookupError):
    pass


class ConflictError(TierlakeError):
    pass


class CapExceededError(TierlakeError):
    pass


class StorageError(TierlakeError):
    """A file of the store cannot be read or written."""


class SchemaError(StorageError):
    """The store's version is not one that this library reads."""


class TenantError(TierlakeError):
    """Rows of another tenant than the client's."""


def _schema(text: str) -> T.StructType:
    """A schema of plain columns; made without a session, as this module is imported before there is one."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split(" ") for c in text.split(", "))])


#: Every table has a sequence number in the place of a row id; logs of keyed tables have an operation as well.
TABLES = {
    "entities": _schema("seq long, op string, id string, tenant_id string, category string, name string, status string, body string, ts string"),
    "entity_relations": _schema("seq long, id string, tenant_id string, from_id string, to_id string, relation_type string, metadata string, created_at string"),
    "state_documents": _schema("seq long, op string, tenant_id string, document_key string, body string, ts string"),
    "journal_events": _schema("seq long, id string, tenant_id string, ts string, evaluated string, acted string, forward string, extra string"),
    "revenue_events": _schema("seq long, id string, tenant_id string, ts string, event_type string, gross_usd double, operator_share_usd double, source string, tx string, entity_id string"),
    "error_events": _schema("seq long, id string, tenant_id string, ts string, code string, message string, context string"),
    "reference_documents": _schema("seq long, op string, tenant_id string, doc_key string, body string, metadata string, ts string"),
    "archived_entities": _schema("seq long, id string, tenant_id string, original_entity_id string, category string, name string, body string, archived_at string, archive_reason string"),
    "flagged_actors": _schema("seq long, id string, tenant_id string, actor_handle string, actor_address string, flagged_at string, reason string, evidence string"),
    "skill_proposals": _schema("seq long, id string, tenant_id string, created_at string, pattern_kind string, proposed_slug string, proposed_title string, proposed_body string, evidence string, confidence double, summarizer string, status string, reviewed_at string, review_note string, accepted_doc_key string"),
    "learning_runs": _schema("seq long, id string, tenant_id string, started_at string, completed_at string, summarizer string, events_scanned long, proposals_made long, cursor_after_seq long, cursor_after_ts string"),
}
KEYS = {"entities": ["tenant_id", "category", "name"], "state_documents": ["tenant_id", "document_key"], "reference_documents": ["tenant_id", "doc_key"]}


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of a query as a table that is part of its plan: no job and no Python worker reads it."""
    fields = T.StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=fields.names), fields)


def valid_identifier(value: object) -> str:
    """The identifier, or a ValidationError."""
    if not isinstance(value, str) or not value or len(value) > MAX_IDENTIFIER or ".." in value or set(value) & _FORBIDDEN or any(ord(c) < 0x20 or ord(c) == 0x7F for c in value):
        raise ValidationError(f"not a valid identifier: {value!r}"[:200])
    return value


def valid_identifier_col(c: Column) -> Column:
    bad = F.rlike(c, F.lit(r"[\x00-\x1f\x7f<>|;\x22`]")) | F.contains(c, F.lit("..")) | (F.length(c) > MAX_IDENTIFIER) | (c == "")
    return F.coalesce(~bad, F.lit(False))


def is_container(c: Column) -> Column:
    """Whether JSON text is an object or an array."""
    return F.rlike(c, F.lit(r"^\s*[\{\[]"))


def coerced_body(c: Column) -> Column:
    """Primitive JSON wrapped as {"value": ...}; containers stay."""
    return F.when(is_container(c), c).otherwise(F.concat(F.lit('{"value":'), F.coalesce(c, F.lit("null")), F.lit("}")))


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tenant_of(tenant: str | None, account: str | None, explicit: str | None = None) -> str:
    """The first of them that is not blank, else the default tenant."""
    return next((x for x in (explicit, tenant, account) if x and x.strip()), DEFAULT_TENANT)


def tenant_col(tenant: Column, account: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(tenant), blank(account), F.lit(DEFAULT_TENANT))


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The live row of every key of a put/delete log.

    created_at (and id) are those of the first put since the key's last delete, updated_at that of
    the last put. Two aggregates with map-side combine, so a key with many versions costs no sort
    and is never gathered.
    """
    payload = [c for c in log.columns if c not in (*keys, "seq", "op", "ts", "id")]
    born = ["seq", "ts", *(["id"] if "id" in log.columns else [])]
    is_del = F.col("op") == "delete"
    last = log.groupBy(*keys).agg(F.max(F.struct("seq", "op", "ts", *payload)).alias("last"), F.max(F.when(is_del, F.col("seq"))).alias("gone"))
    live = last.where(F.col("last.op") != "delete")
    puts = log.where(~is_del).select(*keys, F.struct(*born).alias("put"))
    first = puts.join(live.select(*keys, "gone"), keys).where(F.col("put.seq") > F.coalesce("gone", F.lit(-1))).groupBy(*keys).agg(F.min("put").alias("put"))
    cols = [*keys, *(["put.id"] if "id" in log.columns else []), *[F.col(f"last.{c}").alias(c) for c in payload]]
    return live.join(first, keys).select(*cols, F.col("put.ts").alias("created_at"), F.col("last.ts").alias("updated_at"), F.col("last.seq").alias("seq"))


def with_delta(snapshot: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """``latest`` of a log whose earlier part is known by its live rows: those of later rows' keys are made anew, all others stay.

    A key that comes again keeps its created_at (and id), unless it was deleted in between.
    """
    named = "id" in log.columns
    own = [c for c in ("id", "created_at") if c in snapshot.columns]
    payload = [c for c in log.columns if c not in (*keys, "seq", "op", "ts", "id")]
    is_del = F.col("op") == "delete"
    last = log.groupBy(*keys).agg(F.max(F.struct("seq", "op", "ts", *payload)).alias("last"), F.max(F.when(is_del, F.col("seq"))).alias("gone"))
    puts = log.where(~is_del).select(*keys, F.struct("seq", "ts", *(["id"] if named else [])).alias("put"))
    first = puts.join(last.select(*keys, "gone"), keys).where(F.col("put.seq") > F.coalesce("gone", F.lit(-1))).groupBy(*keys).agg(F.min("put").alias("put"))
    before = snapshot.select(*keys, F.struct(*own).alias("was"))
    new = last.where(F.col("last.op") != "delete").join(first, keys).join(before, keys, "left")
    kept = F.col("was").isNotNull() & F.col("gone").isNull()
    born = lambda was, now: F.when(kept, F.col(f"was.{was}")).otherwise(F.col(now))
    made = new.select(
        *keys, *([born("id", "put.id").alias("id")] if named else []), *[F.col(f"last.{c}").alias(c) for c in payload],
        born("created_at", "put.ts").alias("created_at"), F.col("last.ts").alias("updated_at"), F.col("last.seq").alias("seq"),
    )
    return snapshot.join(last.select(*keys), keys, "left_anti").select(*made.columns).unionByName(made)


class Store:
    """A folder of parquet logs, one per table, partitioned by tenant.

    Single rows are appended to a table's open folder. Rows of several tables that belong together are written to
    folders of their own, which one new state of the manifest names, or none does. ``compact`` closes a
    table's folders: a keyed table gets a snapshot of its live rows, sorted by key with Bloom filters, beside which only
    what came later is read for the live rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        from .manifest import Manifest

        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, f"{self.root}/_state")

    def _state(self) -> tuple[int, dict]:
        n, state = self.manifest.read()
        return n, state or {"tables": {}, "garbage": []}

    @staticmethod
    def _of(state: dict, table: str) -> dict:
        """A table's folders: ``open`` takes rows, ``parts`` have come since the snapshot, ``old`` before it."""
        return state["tables"].get(table) or {"open": table, "parts": [], "old": [], "snapshot": None, "seq": 0}

    def _folders(self, names: list[str], schema: T.StructType) -> DataFrame:
        out = None
        for name in filter(self._exists, names):  # apart, as each has its own folders of tenants
            part = self._read(name, schema)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        system, path = self._path(name)
        return system.exists(path)

    def create(self) -> None:
        """Note the version in a new store; one that has a version stays as it is, a later one is refused."""
        version = self.versions().agg(F.max("version")).first()[0]
        if version is None:
            row = self.spark.createDataFrame([(SCHEMA_VERSION,)], "version int")
            row.coalesce(1).write.mode("append").parquet(f"{self.root}/_version")
        elif version > SCHEMA_VERSION:
            raise SchemaError(f"the store has version {version}, this library reads {SCHEMA_VERSION}")

    def versions(self) -> DataFrame:
        """(version): those that the store has had."""
        return self._read("_version", T.StructType([T.StructField("version", T.IntegerType())]))

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise StorageError(f"{folder}: {e}") from e

    def scan(self, table: str, tenant: str | None = None) -> DataFrame:
        """All rows of a table, empty if nothing has been written; a tenant prunes partitions."""
        own = self._of(self._state()[1], table)
        return self._owned(self._rows([*own["old"], *own["parts"], own["open"]], table), tenant)

    def _rows(self, names: list[str], table: str) -> DataFrame:
        return self._folders(names, TABLES[table]) if len(names) > 1 else self._read(names[0], TABLES[table])

    @staticmethod
    def _owned(df: DataFrame, tenant: str | None) -> DataFrame:
        return df.where(F.col("tenant_id") == tenant) if tenant is not None else df

    def _written(self, table: str, rows: DataFrame, folder: str) -> None:
        names = [f.name for f in TABLES[table]]
        rows.select(*[F.col(c).cast(TABLES[table][c].dataType) if c in rows.columns else F.lit(None).cast(TABLES[table][c].dataType).alias(c) for c in names]).write.mode("append").partitionBy("tenant_id").parquet(f"{self.root}/{folder}")

    def append(self, table: str, rows: DataFrame) -> None:
        self._written(table, rows, self._of(self._state()[1], table)["open"])

    def commit(self, rows: dict[str, DataFrame], after: int | None = None) -> None:
        """Append to several tables, all or none. ``after``: the state that the rows were made from; ConflictError if another has come since."""
        n, state = self._state()
        if after is not None and after != n:
            raise ConflictError(f"the store has changed since state {after}")
        tables = dict(state["tables"])
        for table, df in rows.items():
            folder = f"_parts/{table}/{uuid.uuid4().hex}"
            self._written(table, df, folder)
            own = self._of(state, table)
            tables[table] = own | {"parts": [*own["parts"], folder]}
        self.manifest.commit(n, state | {"tables": tables})

    def version(self) -> int:
        """The number of the manifest's state, for ``commit``."""
        return self._state()[0]

    def next_seq(self, table: str) -> int:
        own = self._of(self._state()[1], table)
        newer = self._rows([*own["parts"], own["open"]], table).agg(F.max("seq")).first()[0] or 0
        return max(newer, own["seq"]) + 1

    def _snapshot(self, own: dict, tenant: str | None) -> DataFrame | None:
        return None if own["snapshot"] is None else self._owned(self.spark.read.parquet(f"{self.root}/{own['snapshot']}"), tenant)

    def live(self, table: str, tenant: str | None = None) -> DataFrame:
        if table not in KEYS:
            return self.scan(table, tenant)
        return self._live(table, tenant, lambda df: df)

    def _live(self, table: str, tenant: str | None, some: Callable[[DataFrame], DataFrame]) -> DataFrame:
        own = self._of(self._state()[1], table)
        snapshot = self._snapshot(own, tenant)
        log = some(self._owned(self._rows([*own["parts"], own["open"]], table), tenant))
        return latest(log, KEYS[table]) if snapshot is None else with_delta(some(snapshot), log, KEYS[table])

    def one(self, table: str, tenant: str, **keys: str):
        """The live row of one key, or None. The key is pushed to the snapshot, whose Bloom filters skip files, and to what came after it."""
        def some(df: DataFrame) -> DataFrame:
            for name, value in keys.items():
                df = df.where(F.col(name) == value)
            return df

        return self._live(table, tenant, some).first()

    def compact(self, table: str) -> None:
        """Close a table's folders: what came since the last time becomes one sorted folder, and a keyed table a new snapshot.

        Rows that come meanwhile belong to the next time: the open folder changes first.
        """
        n, state = self._state()
        own = self._of(state, table)
        name = uuid.uuid4().hex
        closed = [*own["parts"], own["open"]]
        rows = self._rows(closed, table)
        own = own | {"open": f"_open/{table}/{name}", "parts": [f for f in closed if self._exists(f)]}
        for old in state["garbage"]:  # of the time before last
            system, path = self._path(old)
            system.delete(path, True)
        state = state | {"tables": state["tables"] | {table: own}, "garbage": []}
        n = self.manifest.commit(n, state)
        top = rows.agg(F.max("seq")).first()[0]
        if top is None:
            return
        keys = [k for k in KEYS.get(table, []) if k != "tenant_id"]
        order = keys or (["ts"] if "ts" in rows.columns else ["seq"])
        rows.repartitionByRange("tenant_id", *order).sortWithinPartitions("tenant_id", *order).write.partitionBy("tenant_id").parquet(f"{self.root}/_parts/{table}/{name}")
        garbage = list(own["parts"])
        if keys:
            snapshot = self._snapshot(own, None)
            live = latest(rows, KEYS[table]) if snapshot is None else with_delta(snapshot, rows, KEYS[table])
            writer = live.repartitionByRange("tenant_id", *keys).sortWithinPartitions("tenant_id", *keys).write.partitionBy("tenant_id")
            for key in keys:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            writer.parquet(f"{self.root}/_snapshots/{table}/{name}")
            garbage += [own["snapshot"]] if own["snapshot"] else []
            own = own | {"snapshot": f"_snapshots/{table}/{name}", "old": [*own["old"], f"_parts/{table}/{name}"], "parts": []}
        else:
            own = own | {"parts": [f"_parts/{table}/{name}"]}
        self.manifest.commit(n, state | {"tables": state["tables"] | {table: own | {"seq": max(top, own["seq"])}}, "garbage": garbage})

    def proposals(self, tenant: str | None = None) -> DataFrame:
        """Every proposal as it stands: a review appends a row of the same id."""
        rows = self.scan("skill_proposals", tenant)
        names = rows.columns
        return rows.groupBy("tenant_id", "id").agg(F.max_by(F.struct(*names), "seq").alias("r")).select("r.*")

    def relations(self, tenant: str | None = None) -> DataFrame:
        """Relations both of whose ends are live: one goes with either entity."""
        ids = self.live("entities", tenant).select("tenant_id", "id")
        rows = self.scan("entity_relations", tenant)
        for end in ("from_id", "to_id"):
            rows = rows.join(ids.withColumnRenamed("id", end), ["tenant_id", end], "left_semi")
        return rows

    def revenue(self, tenant: str | None = None) -> DataFrame:
        """Revenue events, without the entity where it is gone."""
        ids = self.live("entities", tenant).select("tenant_id", F.col("id").alias("entity_id"), F.lit(True).alias("there"))
        rows = self.scan("revenue_events", tenant)
        found = rows.join(ids, ["tenant_id", "entity_id"], "left").withColumn("entity_id", F.when(F.col("there"), F.col("entity_id")))
        return found.select(*rows.columns)

    def counts_by_tenant(self, tables: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
        """(table, tenant_id, n): live rows."""
        parts = [self.live(t).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "tenant_id", "n") for t in tables]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def category_counts(self, tenant: str | None = None, before: DataFrame | None = None) -> DataFrame:
        """(category, n, added): live entities, most first; added since ``before`` (category, n), never less than 0."""
        now = self.live("entities", tenant).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        was = F.lit(0)
        if before is not None:
            now, was = now.join(before.select("category", F.col("n").alias("was")), "category", "left"), F.coalesce("was", F.lit(0))
        return now.select("category", "n", F.greatest(F.col("n") - was, F.lit(0)).alias("added")).orderBy(F.desc("n"), "category")

    def archive(self, keys: DataFrame, at: str, reason: str | None = None) -> int:
        """Move live entities (tenant_id, category, name) to the archive; returns how many.

        Both tables change in one state of the manifest: what is cut off in between has changed neither. The rows that
        move are found once, and kept in a folder until both tables have them.
        """
        version = self.version()
        moving = f"{self.root}/_moving/{uuid.uuid4().hex}"
        rows = self.live("entities").join(keys.select(*KEYS["entities"]).distinct(), KEYS["entities"], "left_semi")
        rows.write.parquet(moving)
        rows = self.spark.read.schema(rows.schema).parquet(moving)
        there = self.scan("archived_entities").select(F.col("original_entity_id").alias("id"))
        made = rows.join(there, "id", "left_anti").select(
            F.col("seq"), F.concat(F.lit("a-"), "id").alias("id"), "tenant_id", F.col("id").alias("original_entity_id"), "category", "name", "body", F.lit(at).alias("archived_at"), F.lit(reason).cast("string").alias("archive_reason"),
        )
        gone = rows.withColumn("seq", F.col("seq") * 0 + F.lit(self.next_seq("entities")) + F.monotonically_increasing_id()).withColumn("op", F.lit("delete")).withColumn("ts", F.lit(at))
        try:
            n = rows.count()
            self.commit({"archived_entities": made, "entities": gone.select("seq", "op", "id", *KEYS["entities"], "ts")}, version)
        finally:
            system, path = self._path(moving.removeprefix(f"{self.root}/"))
            system.delete(path, True)
        return n

    def count_rows(self, table: str, tenant: str) -> int:
        if table not in ("entities", "state_documents", "journal_events", "reference_documents", "archived_entities"):
            raise ValidationError(f"rows of {table} are not counted")
        return self.live(table, tenant).count()

    def payload_bytes(self, tenant: str | None = None) -> int:
        """Bytes of the live payloads, the store's logical size."""
        total = 0
        for table, columns in {"entities": ["body"], "state_documents": ["body"], "reference_documents": ["body", "metadata"], "journal_events": ["evaluated", "acted", "forward", "extra"], "archived_entities": ["body"]}.items():
            size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
            total += self.live(table, tenant).agg(F.sum(size)).first()[0] or 0
        return total


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, for derived data: under ``spark.checkpoint.dir``, or on one machine a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise StorageError("spark.checkpoint.dir is not set, and executors do not see the driver's folders")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="tierlake-")
    return f"file://{_LOCAL['folder']}"


_LOCAL: dict[str, str] = {}


def stored_files(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """(path, length) of files, each once."""
    return spark.read.format("binaryFile").load(pattern).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length").dropDuplicates(["path"])


def discovered(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, length) of the files that any pattern names, each once by the place it resolves to; patterns without a file give none.

    A pattern with a scheme is looked up in its file system, one without on this machine.
    """
    import glob
    import os

    # names only; a store's folders are few
    found = set()
    for p in patterns:
        if "://" in p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
            found |= {f.getPath().toString() for f in listed or [] if f.isFile()}
        else:
            found |= {os.path.realpath(f) for f in glob.glob(os.path.expanduser(p), recursive=True) if os.path.isfile(f)}
    return stored_files(spark, sorted(found)) if found else spark.createDataFrame([], "path string, length long")


def total_size(files: DataFrame) -> int:
    return files.agg(F.sum("length")).first()[0] or 0


def credentials(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id of credential files, by the ladder tenant, account, default."""
    rows = spark.read.schema("tenant_id string, account_id string").option("multiLine", True).json(path)
    return rows.select(tenant_col(F.col("tenant_id"), F.col("account_id")).alias("tenant_id"))


def safe_name(text: str) -> str:
    return re.sub("[^A-Za-z0-9_.-]", "_", text)

"""The client: writes as appended log rows, reads as views of the latest rows."""

from __future__ import annotations

import asyncio
import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import clamp_limit
from ..sources.tables import DEFAULT_TENANT, KEYS, MAX_BODY_BYTES, TABLES, CapExceededError, ConflictError, NotFoundError, Store, TenantError, ValidationError, is_container, valid_identifier, valid_identifier_col
from . import documents, index, learn, lint, search, shape


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def dumps(value: object) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


#: Payload columns, whose bytes count against the cap.
PAYLOAD = ("body", "metadata", "evaluated", "acted", "forward", "extra")


#: Writes of a table, each a file, after which it is compacted.
COMPACT_EVERY = 64


class Memory:
    """A tenant's view of a store. Single writes append one row; ``put_all`` takes a DataFrame.

    A client is its store's one writer: it reads the last numbers and the size once and counts on by itself.
    """

    def __init__(self, spark: SparkSession, root: str, tenant: str = DEFAULT_TENANT, paid: bool = False):
        self.store, self.tenant, self.paid, self.spark = Store(spark, root), tenant, paid, spark
        self.store.create()
        self.segments = index.Segments(self.store)
        self._next: dict[str, int] = {}
        self._files: dict[str, int] = {}
        self._bytes: int | None = None

    def _seq(self, table: str, n: int = 1) -> int:
        """The first of n new numbers of a table."""
        if table not in self._next:
            self._next[table] = self.store.next_seq(table)
        self._next[table] += n
        return self._next[table] - n

    def _admit(self, size: int) -> None:
        if self._bytes is None and not self.paid:
            self._bytes = self.store.payload_bytes(self.tenant)
        if not self.paid and not shape.write_allowed(self._bytes, size):
            self._bytes = self.store.payload_bytes(self.tenant)  # deletes and rewrites may have made room
            if not shape.write_allowed(self._bytes, size):
                raise CapExceededError("the store's cap is reached")
        self._bytes = (self._bytes or 0) + size

    def _row(self, table: str, row: dict) -> tuple[dict, DataFrame]:
        """A row with its number, as it stands and as a table."""
        self._admit(sum(len(str(row[c]).encode()) for c in PAYLOAD if row.get(c) is not None))
        row = {"seq": self._seq(table), "tenant_id": self.tenant} | row
        return row, self.spark.createDataFrame([tuple(row.get(f.name) for f in TABLES[table])], TABLES[table])

    def _add(self, table: str, **row) -> dict:
        row, df = self._row(table, row)
        self.store.append(table, df)
        self._written(table)
        return row

    def _written(self, table: str) -> None:
        """Every write makes a file; after COMPACT_EVERY of them the table is compacted."""
        self._files[table] = self._files.get(table, 0) + 1
        if self._files[table] >= COMPACT_EVERY:
            self._files[table] = 0
            self.store.compact(table)

    def _add_all(self, after: int, **rows: dict) -> dict[str, dict]:
        """One row for each table, all or none; ConflictError if another writer came since state ``after``."""
        made = {table: self._row(table, row) for table, row in rows.items()}
        self.store.commit({table: df for table, (_, df) in made.items()}, after)
        return {table: row for table, (row, _) in made.items()}

    @staticmethod
    def _body(value: object) -> str:
        if not isinstance(value, (dict, list)):
            raise ValidationError("a body is an object or an array")
        text = dumps(value)
        if len(text.encode()) > MAX_BODY_BYTES:
            raise ValidationError("the body is too large")
        return text

    def set_entity(self, category: str, name: str, body: object, status: str | None = None, ts: str | None = None) -> dict:
        self._add("entities", op="put", id=str(uuid.uuid4()), category=valid_identifier(category), name=valid_identifier(name), status=status, body=self._body(body), ts=ts or now())
        return self.get_entity(category, name)

    def get_entity(self, category: str, name: str) -> dict:
        row = self.store.one("entities", self.tenant, category=category, name=name)
        if row is None:
            raise NotFoundError(f"{category}/{name}")
        return row.asDict() | {"body": json.loads(row["body"])}

    def recall(self, category: str, name: str) -> dict | None:
        try:
            return self.get_entity(category, name)
        except NotFoundError:
            return None

    def delete_entity(self, category: str, name: str) -> bool:
        if self.recall(category, name) is None:
            return False
        self._add("entities", op="delete", category=category, name=name, ts=now())
        return True

    def archive_entity(self, category: str, name: str, reason: str | None = None) -> dict:
        """Move an entity to the archive, in one state of the store."""
        version, row = self.store.version(), self.get_entity(category, name)
        entry = {"id": str(uuid.uuid4()), "original_entity_id": row["id"], "category": category, "name": name, "body": dumps(row["body"]), "archived_at": now(), "archive_reason": reason}
        self._add_all(version, archived_entities=entry, entities={"op": "delete", "category": category, "name": name, "ts": now()})
        return {"archived_id": entry["id"], "original_id": row["id"]}

    def list_entities(self, category: str | None = None, status: str | None = None, limit: object = 100) -> DataFrame:
        rows = self.store.live("entities", self.tenant)
        for c, v in (("category", category), ("status", status)):
            if v is not None:
                rows = rows.where(F.col(c) == v)
        return rows.orderBy(F.desc("updated_at"), F.desc("seq")).limit(clamp_limit(limit))

    def set_state(self, key: str, body: object) -> None:
        self._add("state_documents", op="put", document_key=valid_identifier(key), body=self._body(body), ts=now())

    def get_state(self, key: str) -> object | None:
        row = self.store.one("state_documents", self.tenant, document_key=key)
        return None if row is None else json.loads(row["body"])

    def set_reference(self, key: str, body: object, metadata: dict | None = None) -> None:
        if not isinstance(body, (str, dict, list)):
            raise ValidationError("a reference is text, an object or an array")
        self._add("reference_documents", op="put", doc_key=valid_identifier(key), body=body if isinstance(body, str) else dumps(body), metadata=dumps(metadata), ts=now())

    def get_reference(self, key: str) -> str | None:
        row = self.store.one("reference_documents", self.tenant, doc_key=key)
        return None if row is None else row["body"]

    def write_event(self, evaluated=None, acted=None, forward=None, extra=None, ts: str | None = None) -> str:
        return self._add("journal_events", id=str(uuid.uuid4()), ts=ts or now(), evaluated=dumps(evaluated), acted=dumps(acted), forward=dumps(forward), extra=dumps(extra))["id"]

    def record_event(self, kind: str, body: object, category: str | None = None, name: str | None = None) -> str:
        extra = {k: v for k, v in (("category", category), ("name", name)) if v is not None}
        return self.write_event(acted={"kind": kind, "body": body}, extra=extra or None)

    def save_context(self, inputs: object, outputs: object, ts: str | None = None) -> str:
        return self.write_event(evaluated=inputs, acted=outputs, ts=ts)

    def read_events(self, limit: object = 50, since: str | None = None, until: str | None = None) -> DataFrame:
        rows = self.store.scan("journal_events", self.tenant)
        if since is not None:
            rows = rows.where(F.col("ts") >= since)
        if until is not None:
            rows = rows.where(F.col("ts") <= until)
        return rows.orderBy(F.desc("ts"), F.desc("id")).limit(clamp_limit(limit))

    load_context = read_events

    def mirror(self, action: str, target: str, content: str, metadata: dict | None = None) -> str | None:
        """Keep what another memory holds, keyed by a digest of its content; ``remove`` deletes it."""
        if not content:
            return None
        name = hashlib.blake2b(content.encode("utf-8", "replace"), digest_size=6).hexdigest()
        if action in ("add", "replace"):
            self.set_entity(target, name, {"content": content, "metadata": metadata or {}})
        elif action == "remove":
            self.delete_entity(target, name)
        return name

    def record_delegation(self, task: str, result: str, child: str = "", session: str = "") -> str:
        return self.save_context({"delegated_task": task, "child_sid": child, "session_id": session}, {"child_result": result})

    #: The same verb is a deletion for one adapter and a move to the archive for another.
    forget = delete_entity
    memory_forget = archive_entity

    def put_all(self, table: str, rows: DataFrame) -> int:
        """Append a batch of put rows, all or none; returns their number.

        All keys and bodies are checked first, and the batch against the cap. The seq follows the
        order of ts, then of the keys' hash; ids follow from key and seq.
        """
        if table not in KEYS:
            raise ValidationError(f"{table} has no keys")
        if "tenant_id" in rows.columns and rows.where(~F.col("tenant_id").eqNullSafe(self.tenant)).limit(1).count():
            raise TenantError("rows of another tenant")
        keys = [k for k in KEYS[table] if k != "tenant_id"]
        good = F.octet_length("body") <= MAX_BODY_BYTES
        for k in keys:
            good = good & valid_identifier_col(F.col(k))
        if table != "reference_documents":
            good = good & is_container(F.col("body")) & F.coalesce(lint.json_valid(F.col("body")), F.lit(False))
        n, bad, size = rows.select(F.coalesce(good, F.lit(False)).alias("ok"), F.coalesce(F.octet_length("body"), F.lit(0)).alias("b")).agg(F.count(F.lit(1)), F.sum((~F.col("ok")).cast("long")), F.sum("b")).first()
        if bad:
            raise ValidationError(f"{bad} of {n} rows are not valid")
        if not n:
            return 0
        self._admit(size)
        ts = F.coalesce(F.col("ts"), F.lit(now())) if "ts" in rows.columns else F.lit(now())
        rows = rows.withColumn("ts", ts).withColumn("op", F.lit("put")).withColumn("tenant_id", F.lit(self.tenant))
        rows = rows.orderBy("ts", F.xxhash64(*keys)).withColumn("seq", F.monotonically_increasing_id() + self._seq(table))
        made = F.sha2(F.concat_ws("/", "tenant_id", *keys, F.col("seq").cast("string")), 256)
        rows = rows.withColumn("id", F.concat_ws("-", *[F.substring(made, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
        self.store.append(table, rows)
        del self._next[table]  # numbers are in order, but not without gaps
        return n

    def build_index(self, path: str | None = None, **options) -> tuple[index.Index, DataFrame]:
        """The index over all tenants (its figures are global), and the folded documents.

        As a rule that kept beside the store, brought up to date; with a path or options one of its own.
        """
        if path is None and not options:
            built = self.segments.index()
            return built, built.substrings()
        live = self.store.live
        docs = index.searchable(live("entities"), live("state_documents"), live("reference_documents"), live("journal_events"))
        built = index.build(docs, **options)
        built = built.save(path) if path else built
        return built, built.substrings()

    def rebuild_index(self) -> None:
        self.segments.rebuild()
        self.segments.refresh()

    def search(self, query: str, **options) -> DataFrame:
        built, folded = self.build_index()
        return search.search(built, folded, query, tenant=self.tenant, **options)

    def search_phrase(self, phrase: str, limit: int = 20, tiers: tuple[str, ...] = index.TIERS) -> DataFrame:
        """(tier, key, category, rank): documents that hold the phrase, best first."""
        built = self.build_index()[0]
        found = search.rank_phrase(built, phrase, clamp_limit(limit), tiers=tiers, tenant=self.tenant)
        rows = found.join(built.docs.select("tier", "seq", "key", "category"), ["tier", "seq"])
        return rows.orderBy("rank", "tier", "seq").limit(clamp_limit(limit)).select("tier", "key", "category", "rank")

    def search_entities(self, query: str, **options) -> DataFrame:
        return search.search_entities(self.build_index()[0], query, tenant=self.tenant, **options)

    def search_records(self, query: str, limit: int = 10, **options) -> DataFrame:
        built, folded = self.build_index()
        return search.search_records(built, folded, query, limit, tenant=self.tenant, **options)

    def agent_search(self, query: str, limit: object = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
        """What an agent's search call gives: nothing for fewer than three characters, 1 to 50 hits; within tiers by the ladder, else linked records.

        Markers are taken out of the texts, long ones are cut, and so is the whole answer.
        """
        if len(query.strip()) < 3:
            return search.nothing(self.spark)
        n = min(50, max(1, clamp_limit(limit)))
        hits = self.search(query, limit=n, tiers=tiers) if tiers is not None else self.search_records(query, n)
        scrubbed = hits.withColumns({c: tx.scrub_col(F.col(c)) for c in ("body", "snippet")})
        return shape.bounded(scrubbed, [F.col("pos")])

    def health(self) -> dict:
        """Rows of every tier, and the size."""
        tables = ("entities", "state_documents", "journal_events", "reference_documents", "archived_entities")
        return {t: self.store.count_rows(t, self.tenant) for t in tables} | {"bytes": self.store.payload_bytes(self.tenant), "version": self.store.versions().agg(F.max("version")).first()[0]}

    def prefetch(self, query: str, hits: int = 5) -> DataFrame:
        """The query and its content words searched; hits merged by tier and key."""
        if len(query.strip()) < 10:
            return self.spark.createDataFrame([], "tier string, key string, match_count long, best_rank double")
        built, folded = self.build_index()
        words = [w for w in dict.fromkeys(w.lower() for w in tx.query_tokens(query[:1000])) if w not in tx.STOPWORDS][:5]
        found = search.ladder(built, folded, [query[:1000], *words], limit=hits, tenant=self.tenant)
        enough = F.sum((F.col("q") == 0).cast("int")).over(Window.partitionBy(F.lit(1))) >= hits  # a few rows: hits of seven searches
        rows = found.withColumn("enough", enough).where((F.col("q") == 0) | ~F.col("enough"))
        return shape.merged(rows, hits)

    def learn(self, min_hits: int = 3, since: str | None = None, summarize: Callable[[str, dict, list[dict]], str] | None = None) -> DataFrame:
        """Mine the events past the last run's watermark; append proposals and the run.

        ``summarize`` gets a proposal's kind, what was found (slug, title, detail, hits) and its events
        without their contents, and returns the body; where it fails the template's body stays, with a note.
        """
        last = self.store.scan("learning_runs", self.tenant).orderBy(F.desc("started_at"), F.desc("seq")).first()
        events = learn.load(self.store.scan("journal_events", self.tenant), last["cursor_after_seq"] or 0 if last else 0, since).cache()
        mark = learn.watermark(events).first()
        proposals = learn.rendered(learn.propose(events, self.store.proposals(self.tenant), min_hits)).cache()
        found = proposals.collect()  # at most MAX_PROPOSALS rows
        evidence = {r["slug"]: json.loads(r["evidence"]) for r in learn.all_evidence(events, proposals).collect()} if found else {}
        shapes = {}
        if summarize is not None and evidence:
            ids = sorted({e["event_id"] for es in evidence.values() for e in es})  # at most MAX_EVIDENCE for each
            shapes = {r["id"]: r.asDict() for r in learn.redacted(events.where(F.col("id").isin(ids))).collect()}
        for p in found:
            seen = evidence.get(p["slug"], [])
            body, by = "\n".join([p["proposed_body"], "", "## Evidence", "", *(f"- {e['ts']}: {e.get('snippet') or ''}" for e in seen[:5])]), "template"
            if summarize is not None:
                try:
                    hints = {k: p[k] for k in ("slug", "detail", "hits")} | {"title": p["proposed_title"]}
                    body, by = summarize(p["pattern_kind"], hints, [shapes[e["event_id"]] for e in seen if e["event_id"] in shapes]), "own"
                except Exception as e:  # a summary is worth less than the proposal
                    body += f"\n\n_Without a summary: {e}_"
            self._add("skill_proposals", id=str(uuid.uuid4()), created_at=now(), pattern_kind=p["pattern_kind"], proposed_slug=p["slug"], proposed_title=p["proposed_title"], proposed_body=body, evidence=dumps(seen), confidence=p["confidence"], summarizer=by, status="pending")
        cursor = mark["cursor_after_seq"] if mark["cursor_after_seq"] is not None else (last["cursor_after_seq"] if last else 0)
        self._add("learning_runs", id=str(uuid.uuid4()), started_at=now(), completed_at=now(), summarizer="own" if summarize else "template", events_scanned=mark["events_scanned"], proposals_made=len(found), cursor_after_seq=cursor, cursor_after_ts=mark["cursor_after_ts"])
        proposals.unpersist()
        events.unpersist()
        return self.spark.createDataFrame([(p["pattern_kind"], p["slug"], p["confidence"], p["hits"]) for p in found], "pattern_kind string, slug string, confidence double, hits long")

    def list_proposals(self, status: str | None = "pending", limit: int = 50) -> DataFrame:
        return learn.list_proposals(self.store.proposals(self.tenant), status, limit)

    def get_proposal(self, id_: str) -> dict:
        row = self.store.proposals(self.tenant).where(F.col("id") == id_).first()
        if row is None:
            raise NotFoundError(f"proposal {id_}")
        return row.asDict() | {"evidence": json.loads(row["evidence"] or "[]")}

    def _review(self, id_: str, accept: bool, note: str | None) -> dict:
        version, status = self.store.version(), self.get_proposal(id_)["status"]
        if status != "pending":
            raise ConflictError(f"proposal {id_} is {status}")
        done, refs = learn.review(self.store.proposals(self.tenant), id_, accept, now(), note)
        # one row each at most; both are there, or neither
        rows = {"reference_documents": [r.asDict() for r in refs.collect()], "skill_proposals": [r.asDict() for r in done.collect()]}
        self._add_all(version, **{t: {k: v for k, v in rs[0].items() if k not in ("seq", "tenant_id")} for t, rs in rows.items() if rs})
        return self.get_proposal(id_)

    def accept_proposal(self, id_: str, note: str | None = None) -> dict:
        """A pending proposal becomes the reference skill/<slug>."""
        return self._review(id_, True, note)

    def reject_proposal(self, id_: str, note: str | None = None) -> dict:
        return self._review(id_, False, note)

    def lint(self, as_of: str | None = None) -> DataFrame:
        """All checks; the index is compared where there is one."""
        return lint.lint(self.store, self.tenant, as_of or now(), self.segments.indexed(self.tenant))

    # document-store surface

    def put(self, namespace: tuple[str, ...], key: str, value: dict | None) -> None:
        category = "/".join(documents.checked_namespace(namespace))
        if value is None:
            self.delete_entity(category, key)
        else:
            self.set_entity(category, key, documents.checked_value(value))

    def get(self, namespace: tuple[str, ...], key: str) -> dict | None:
        return self.recall("/".join(documents.checked_namespace(namespace)), key)

    def find(self, prefix: tuple[str, ...] = (), query: str | None = None, **options) -> DataFrame:
        """Documents under a prefix, latest first; with a query those that hold all its words, best first."""
        ranked = None
        if query is not None and query.strip():
            built = self.build_index()[0]
            words = [w.lower() for w in tx.query_tokens(query)]
            ranked = search.rank_words(built, [words] if words else [], None, tiers=("entity",), tenant=self.tenant)
            near = search.nearness(built, {0: words}, ("entity",)).select("seq", "near")
            most = F.lit(2 if len(words) >= 2 else 0)
            ranked = ranked.select("seq", "rank").join(near, "seq", "left").select("seq", F.coalesce("near", most).alias("near"), "rank")
        return documents.timed(documents.search(self.store.live("entities", self.tenant), prefix, ranked=ranked, **options))

    def namespaces(self, **options) -> DataFrame:
        return documents.list_namespaces(self.store.live("entities", self.tenant), **options)

    def batch(self, operations: list[tuple]) -> list:
        """Results of ("get", namespace, key), ("put", namespace, key, value), ("find", {options}) and ("namespaces", {options}), in order.

        All of them are checked before the first is done; a value of None deletes.
        """
        for what, *rest in operations:
            if what in ("get", "put"):
                documents.checked_namespace(rest[0])
                valid_identifier(rest[1])
                if what == "put" and rest[2] is not None:
                    self._body(documents.checked_value(rest[2]))
            elif what not in ("find", "namespaces"):
                raise ValidationError(f"unknown operation: {what}")
        return [getattr(self, what)(*rest) if what in ("get", "put") else getattr(self, what)(**(rest[0] if rest else {})).collect() for what, *rest in operations]

    async def abatch(self, operations: list[tuple]) -> list:
        return await asyncio.to_thread(self.batch, operations)

"""A document store over the entity tier: namespaces are paths in the category, values are JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_page
from ..sources.tables import ValidationError

MAX_DEPTH = 1000


def checked_namespace(parts: tuple[str, ...] | list[str], prefix: bool = False) -> tuple[str, ...]:
    parts = tuple(parts)
    if not parts and not prefix:
        raise ValidationError("an empty namespace is only a prefix")
    if any(not isinstance(p, str) or not p or "/" in p or ".." in p for p in parts):
        raise ValidationError(f"not a namespace: {parts!r}")
    return parts


def checked_value(value: object, depth: int = 0) -> object:
    if depth > MAX_DEPTH:
        raise ValidationError("value is nested too deeply")
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise ValidationError("keys are strings")
        for v in value.values():
            checked_value(v, depth + 1)
    elif isinstance(value, (list, tuple)):
        for v in value:
            checked_value(v, depth + 1)
    return value


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _variant(body: Column, parsed: Column, name: str) -> Column:
    """A top-level field of a body, whatever characters its name has."""
    if "'" not in name:
        return F.try_variant_get(parsed, f"$['{name}']", "variant")
    if '"' not in name:
        return F.try_variant_get(parsed, f'$["{name}"]', "variant")
    return F.from_json(body, "map<string,variant>")[name]  # a path cannot hold both quotes


def _field(v: Column) -> Column:
    """A field as text, its JSON kind (null, boolean, number, string, other), whether it is an integer, and as JSON where it is none of these."""

    def told(x: Column) -> Column:
        kind = x["kind"]
        named = F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number").when(kind == "STRING", "string").otherwise("other")
        text = F.when(kind == "BOOLEAN", F.when(x["text"] == "true", "1").otherwise("0")).otherwise(x["text"])
        whole = F.coalesce(kind.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))"), F.lit(False))
        return F.struct(text.alias("text"), named.alias("kind"), whole.alias("whole"), x["v"].alias("v"))

    return _once(F.struct(F.schema_of_variant(v).alias("kind"), v.cast("string").alias("text"), v.alias("v")), told)


def _compared(text: Column, whole: Column, value: bool | int | float, compare: Callable[[Column, Column], Column]) -> Column:
    """A number compared with a number: two integers exactly, others as doubles."""
    near = compare(text.try_cast("double"), F.lit(float(value)))
    if isinstance(value, float) and not value.is_integer() or abs(value) >= 10**38:
        return near
    return F.when(whole, compare(text.try_cast("decimal(38,0)"), F.lit(str(int(value))).cast("decimal(38,0)"))).otherwise(near)


def _equal(field: Column, value: object) -> Column:
    """Equality as of Python values: a missing field is None, True is 1, 1 is 1.0; integers are not rounded."""
    text, kind, whole = field["text"], field["kind"], field["whole"]
    if value is None:
        return kind == "null"
    if isinstance(value, (bool, int, float)):
        return kind.isin("number", "boolean") & _compared(text, whole, value, lambda a, b: a == b)
    if isinstance(value, str):
        return (kind == "string") & (text == value)
    want = F.to_json(F.try_parse_json(F.lit(json.dumps(value))))
    return (kind == "other") & (F.to_json(field["v"]) == want)


def _ordered(field: Column, op: str, value: object) -> Column:
    text, kind, whole = field["text"], field["kind"], field["whole"]
    compare = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[op]
    if isinstance(value, (bool, int, float)):
        return kind.isin("number", "boolean") & _compared(text, whole, value, compare)
    return (kind == "string") & compare(text, F.lit(value)) if isinstance(value, str) else F.lit(False)


def compile_filter(body: Column, spec: dict) -> Column:
    """A condition from {field: value} or {field: {operator: operand}}; all have to hold.

    $eq, $ne, $gt, $gte, $lt, $lte, $in, $nin. A missing field equals None, so $ne and $nin pass on
    it; values of other types than the operand's are not ordered; a string as the operand of $in
    asks whether it contains the value. A body is parsed once, and a field read once.
    """

    def one(field: Column, op: str, operand: object) -> Column:
        if op in ("$eq", "$ne"):
            same = F.coalesce(_equal(field, operand), F.lit(False))
            return same if op == "$eq" else ~same
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return F.coalesce(_ordered(field, op, operand), F.lit(False))
        if op in ("$in", "$nin"):
            if isinstance(operand, str):
                some = (field["kind"] == "string") & F.contains(F.lit(operand), field["text"])
            elif hasattr(operand, "__iter__"):
                some = F.lit(False)
                for v in operand:  # type: ignore[attr-defined]
                    some = some | F.coalesce(_equal(field, v), F.lit(False))
            else:
                raise ValueError(f"{op} takes a collection")
            some = F.coalesce(some, F.lit(False))
            return some if op == "$in" else ~some
        raise ValueError(f"unknown operator: {op}")

    def held(want: object) -> Callable[[Column], Column]:
        def all_of(field: Column) -> Column:
            if isinstance(want, dict) and want and all(k.startswith("$") for k in want):
                out = F.lit(True)
                for op, operand in want.items():
                    out = out & one(field, op, operand)
                return out
            return one(field, "$eq", want)

        return all_of

    def every(parsed: Column) -> Column:
        out = F.lit(True)
        for name, want in spec.items():
            out = out & _once(_field(_variant(body, parsed, name)), held(want))
        return out

    return _once(F.try_parse_json(body), every) if spec else F.lit(True)


def path_matches(path: Column, pattern: tuple[str, ...], at: str = "prefix") -> Column:
    """Whether an array of path elements begins (or ends) with a pattern, in which * stands for any element."""
    if at not in ("prefix", "suffix"):
        raise ValueError(f"unknown match type: {at}")
    out = F.size(path) >= len(pattern)
    for i, p in enumerate(pattern):
        if p != "*":
            out = out & (F.get(path, F.lit(i) if at == "prefix" else F.size(path) - len(pattern) + i) == p)
    return out


def search(entities: DataFrame, prefix: tuple[str, ...] = (), filter: dict | None = None, limit: int | None = 10, offset: int | None = 0, ranked: DataFrame | None = None) -> DataFrame:
    """(namespace, key, value, created_at, updated_at) under a namespace prefix, latest first.

    Prefix and filter hold before the page is cut, over all entities. ``ranked``, (seq, near, rank) of
    the entities that a query finds, keeps these only, best first.
    """
    n, skip = clamp_page(limit, offset)
    path = F.split("category", "/")
    prefix = checked_namespace(prefix, prefix=True)
    rows = entities
    for i, p in enumerate(prefix):
        rows = rows.where(F.get(path, F.lit(i)) == p)
    if filter:
        rows = rows.where(compile_filter(F.col("body"), filter))
    order = [F.desc("updated_at"), F.desc("seq")]
    if ranked is not None:
        rows, order = rows.join(ranked.select("seq", "near", "rank"), "seq"), [F.col("near"), F.col("rank"), F.col("seq")]
    rows = rows.orderBy(*order).offset(skip).limit(n)
    return rows.select(path.alias("namespace"), F.col("name").alias("key"), F.col("body").alias("value"), "created_at", "updated_at")


def list_namespaces(entities: DataFrame, prefix: tuple[str, ...] | None = None, suffix: tuple[str, ...] | None = None, max_depth: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Distinct namespaces that match, then cut to a depth, distinct again, in order."""
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth is not negative")
    paths = entities.select("category").distinct().select(F.split("category", "/").alias("namespace"))
    for pattern, at in ((prefix, "prefix"), (suffix, "suffix")):
        if pattern:
            paths = paths.where(path_matches(F.col("namespace"), pattern, at))
    if max_depth is not None:
        paths = paths.select(F.slice("namespace", 1, max_depth).alias("namespace") if max_depth else F.array().cast("array<string>").alias("namespace")).distinct()
    n, skip = clamp_page(limit, offset, 100)
    return paths.orderBy("namespace").offset(skip).limit(n)


def timed(rows: DataFrame) -> DataFrame:
    """created_at and updated_at as timestamps; what is none is now."""
    return rows.withColumns({c: F.coalesce(F.try_to_timestamp(F.col(c)), F.current_timestamp()) for c in ("created_at", "updated_at")})

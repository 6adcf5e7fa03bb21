"""The JSON filter dialect: parse, compile to a Spark predicate, and back to JSON.

Fields are top-level names.  ``{"f": v}`` and ``$eq`` compare, a missing field never matches; ``$ne`` matches a missing
field (unless ``ne_requires_field``); ``$gt $gte $lt $lte`` order numbers as doubles, or strings; ``$in`` takes a list;
``$and`` / ``$or`` take lists of filters (empty: true / false); several fields, or several operators on a field, all have to
hold.  On typed columns equality is that of SQL; on a variant column JSON types count, so 1, 1.0 and "1" differ.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import InvalidFilter

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Test:
    """One operator on one field."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


def parse(spec: Any):
    """The filter tree of a JSON document (a mapping or its text)."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise InvalidFilter(f"not JSON: {e}") from None
    if not isinstance(spec, Mapping) or not spec:
        raise InvalidFilter("a filter is a non-empty object")
    if len(spec) > 1:
        if any(k.startswith("$") for k in spec):
            raise InvalidFilter("an operator cannot stand beside other keys")
        return All(tuple(_field(k, v) for k, v in spec.items()))
    key, value = next(iter(spec.items()))
    if key in ("$and", "$or"):
        if not isinstance(value, list):
            raise InvalidFilter(f"{key} takes a list")
        parts = tuple(parse(x) for x in value)
        return All(parts) if key == "$and" else Any_(parts)
    if key.startswith("$"):
        raise InvalidFilter(f"unknown operator {key}")
    return _field(key, value)


def _field(name: str, value: Any):
    if not isinstance(value, Mapping):
        return Test("$eq", name, value)
    if not value:
        raise InvalidFilter(f"no operator for {name}")
    tests = []
    for op, operand in value.items():
        if op == "$in":
            if not isinstance(operand, list):
                raise InvalidFilter("$in takes a list")
        elif op not in ("$eq", "$ne", *COMPARISONS):
            raise InvalidFilter(f"unknown operator {op}")
        tests.append(Test(op, name, operand))
    return tests[0] if len(tests) == 1 else All(tuple(tests))


def to_json(tree) -> dict:
    """the filter document of a tree; parsing it gives an equal tree."""
    if isinstance(tree, All):
        return {"$and": [to_json(p) for p in tree.parts]}
    if isinstance(tree, Any_):
        return {"$or": [to_json(p) for p in tree.parts]}
    return {tree.field: {tree.op: tree.value}}


def is_index_eligible(tree) -> bool:
    """whether equality lookups alone decide the filter (no range in it)."""
    if isinstance(tree, (All, Any_)):
        return all(map(is_index_eligible, tree.parts))
    return tree.op not in COMPARISONS


def _compile(tree, test: Callable[[Test], Column]) -> Column:
    if isinstance(tree, All):
        return reduce(lambda a, b: a & b, [_compile(p, test) for p in tree.parts], F.lit(True))
    if isinstance(tree, Any_):
        return reduce(lambda a, b: a | b, [_compile(p, test) for p in tree.parts], F.lit(False))
    return test(tree)


def predicate(df: DataFrame, spec: Any, ne_requires_field: bool = False) -> Column:
    """Predicate over typed columns; columns that ``df`` lacks are missing fields.  Plain comparisons, so they reach the scan."""
    known = {f.name: f.dataType.typeName() for f in df.schema}
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal"}

    def test(t: Test) -> Column:
        c = df[f"`{t.field}`"] if t.field in known else F.lit(None)
        no = F.lit(False)
        if t.field not in known:
            return F.lit(t.op == "$ne" and not ne_requires_field)
        kind = known[t.field]

        def equal(v) -> Column:
            if v is None:
                return c.isNull()
            same = {"boolean": isinstance(v, bool), "string": isinstance(v, str)}.get(kind, kind in numeric and isinstance(v, (int, float)) and not isinstance(v, bool))
            return c.isNotNull() & (c == F.lit(v)) if same else no

        if t.op == "$eq":
            return equal(t.value)
        if t.op == "$ne":
            return ~equal(t.value) & (c.isNotNull() if ne_requires_field else F.lit(True))
        if t.op == "$in":
            return reduce(lambda a, b: a | b, map(equal, t.value), no)
        number = isinstance(t.value, (int, float)) and not isinstance(t.value, bool)
        if not (number and kind in numeric or isinstance(t.value, str) and kind == "string"):
            return no
        return c.isNotNull() & COMPARISONS[t.op](c, F.lit(t.value))

    return _compile(parse(spec) if not isinstance(spec, (Test, All, Any_)) else spec, test)


def variant_predicate(document: Column, spec: Any, ne_requires_field: bool = False) -> Column:
    """Predicate over a variant column, with JSON-typed equality."""

    def test(t: Test) -> Column:
        path = "$[" + json.dumps(t.field) + "]"
        value = F.try_variant_get(document, path, "variant")
        kind = F.schema_of_variant(value)
        present = F.coalesce(value.isNotNull(), F.lit(False))
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        no = F.lit(False)

        def equal(v) -> Column:
            if v is None:
                return present & F.coalesce(F.is_variant_null(value), no)
            if isinstance(v, bool):
                return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(document, path, "boolean") == v), no)
            if isinstance(v, int):
                return F.coalesce((kind == "BIGINT") & (F.try_variant_get(document, path, "bigint") == v), no)
            if isinstance(v, float):
                return F.coalesce(number & (kind != "BIGINT") & (F.try_variant_get(document, path, "double") == v), no)
            if isinstance(v, str):
                return F.coalesce((kind == "STRING") & (F.try_variant_get(document, path, "string") == v), no)
            return F.coalesce(F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(v)))), no)

        if t.op == "$eq":
            return equal(t.value)
        if t.op == "$ne":
            return ~equal(t.value) & (present if ne_requires_field else F.lit(True))
        if t.op == "$in":
            return reduce(lambda a, b: a | b, map(equal, t.value), no)
        if isinstance(t.value, str):
            return F.coalesce((kind == "STRING") & COMPARISONS[t.op](F.try_variant_get(document, path, "string"), F.lit(t.value)), no)
        if isinstance(t.value, (int, float)) and not isinstance(t.value, bool):
            return F.coalesce(number & COMPARISONS[t.op](F.try_variant_get(document, path, "double"), F.lit(float(t.value))), no)
        return no

    return _compile(parse(spec) if not isinstance(spec, (Test, All, Any_)) else spec, test)

"""Metadata predicates compiled to columns.

A field is a column of the table if there is one of that name, so that it reaches the
Parquet scan, and else a key of the ``metadata`` map, cast to the literal's type.
Every predicate is two-valued: a missing field gives what its operator defines, never
null.  ``compat`` makes ``gte`` and ``lte`` true for a missing field.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Range:
    """An inclusive range."""

    low: Any
    high: Any


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    op: str
    parts: tuple[Condition | Group, ...]


def eq(field: str, value: Any) -> Condition:
    return Condition(field, "eq", value)


def ne(field: str, value: Any) -> Condition:
    return Condition(field, "ne", value)


def gt(field: str, value: Any) -> Condition:
    return Condition(field, "gt", value)


def lt(field: str, value: Any) -> Condition:
    return Condition(field, "lt", value)


def gte(field: str, value: Any) -> Condition:
    return Condition(field, "gte", value)


def lte(field: str, value: Any) -> Condition:
    return Condition(field, "lte", value)


def contains(field: str, value: Any) -> Condition:
    return Condition(field, "contains", value)


def in_(field: str, values: Iterable[Any]) -> Condition:
    return Condition(field, "in", tuple(values))


def not_in(field: str, values: Iterable[Any]) -> Condition:
    return Condition(field, "not_in", tuple(values))


def between(field: str, low: Any, high: Any) -> Condition:
    return Condition(field, "between", Range(low, high))


def matches(field: str, pattern: str) -> Condition:
    return Condition(field, "matches", pattern)


def exists(field: str) -> Condition:
    return Condition(field, "exists")


def all_of(*parts: Condition | Group) -> Group:
    return Group("and", parts)


def any_of(*parts: Condition | Group) -> Group:
    return Group("or", parts)


def _literal_type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "double"
    return "string"


def _field(df: DataFrame, name: str, value: Any) -> tuple[Column, T.DataType]:
    if name in df.columns:
        return F.col(name), df.schema[name].dataType
    if "metadata" not in df.columns:
        raise ValueError(f"there is neither a column {name!r} nor a metadata map")
    raw = F.try_element_at(F.col("metadata"), F.lit(name))
    kind = _literal_type(value)
    return (raw if kind == "string" else raw.try_cast(kind)), T.StringType()


def _contains(c: Column, kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array_contains(c, F.lit(value))
    if isinstance(kind, T.MapType):
        return F.map_contains_key(c, F.lit(value)) | F.array_contains(F.map_values(c), F.lit(value))
    return c.cast("string").contains(str(value))


def compile_condition(df: DataFrame, condition: Condition, compat: bool = False) -> Column:
    """The condition on the rows of df."""
    value = condition.value
    sample = value.low if isinstance(value, Range) else next(iter(value), None) if isinstance(value, tuple) else value
    c, kind = _field(df, condition.field, sample)
    ops: dict[str, Callable[[], Column]] = {
        "eq": lambda: c.eqNullSafe(F.lit(value)),
        "ne": lambda: ~c.eqNullSafe(F.lit(value)),
        "gt": lambda: F.coalesce(c > value, F.lit(False)),
        "lt": lambda: F.coalesce(c < value, F.lit(False)),
        "gte": lambda: F.coalesce(c >= value, F.lit(compat)),
        "lte": lambda: F.coalesce(c <= value, F.lit(compat)),
        "contains": lambda: F.coalesce(_contains(c, kind, value), F.lit(False)),
        "in": lambda: F.coalesce(c.isin(*value), F.lit(False)) if value else F.lit(False),
        "not_in": lambda: F.coalesce(~c.isin(*value), F.lit(True)) if value else F.lit(True),
        "between": lambda: F.coalesce(c.between(value.low, value.high), F.lit(False)),
        "matches": lambda: F.coalesce(c.cast("string").rlike(rf"\A(?:{value})\z"), F.lit(False)),
        "exists": lambda: c.isNotNull() if condition.field in df.columns else F.coalesce(F.map_contains_key(F.col("metadata"), F.lit(condition.field)), F.lit(False)),
    }
    if condition.op not in ops:
        raise ValueError(f"unknown operator {condition.op!r}")
    return ops[condition.op]()


def compile_filter(df: DataFrame, spec: Condition | Group | Mapping[str, Any] | None, compat: bool = False) -> Column:
    """A condition, a nested group or a map of simple filters as one column; no filter takes every row."""
    if spec is None:
        return F.lit(True)
    if isinstance(spec, Condition):
        return compile_condition(df, spec, compat)
    if isinstance(spec, Group):
        parts = [compile_filter(df, p, compat) for p in spec.parts]
        if spec.op == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return compile_filter(df, from_map(spec), compat)


def from_map(spec: Mapping[str, Any] | None) -> Group | None:
    """A collection means one of it, a Range the range, a compiled pattern a full match, anything else equality."""
    if not spec:
        return None

    def one(field: str, value: Any) -> Condition:
        if isinstance(value, Range):
            return between(field, value.low, value.high)
        if isinstance(value, re.Pattern):
            return matches(field, value.pattern)
        if isinstance(value, (list, tuple, set, frozenset)):
            return in_(field, value)
        return eq(field, value)

    return all_of(*(one(k, v) for k, v in spec.items()))


def lenient_equals(df: DataFrame, field: str, value: Any) -> Column:
    """Equality without regard to type: numbers as doubles, lists by membership, all else as text; missing is false."""
    c, kind = _field(df, field, value)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_contains(c, F.lit(value)), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce(c.try_cast("boolean") == value, F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(c.try_cast("double") == float(value), F.lit(False))
    return F.coalesce(c.cast("string") == str(value), F.lit(False))


def apply_filter(df: DataFrame, spec: Condition | Group | Mapping[str, Any] | None, compat: bool = False) -> DataFrame:
    return df.where(compile_filter(df, spec, compat))


def remote_where(spec: Mapping[str, Any] | None) -> dict[str, Any]:
    """The filter in the form that a remote vector service takes."""
    out: dict[str, Any] = {}
    for k, v in (spec or {}).items():
        if isinstance(v, Range):
            out[k] = {"$gte": v.low, "$lte": v.high}
        elif isinstance(v, (list, tuple, set, frozenset)):
            out[k] = {"$in": list(v)}
        else:
            out[k] = v if isinstance(v, (str, int, float, bool)) else str(v)
    return out

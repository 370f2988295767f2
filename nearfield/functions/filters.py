"""Metadata predicates: a small tree that compiles to a Column with two-valued logic.

Fields are columns whose declared type is the tag of the value, or keys of a map column of tagged
values (``VALUE``). Equality is typed (an integer equals no float), order compares integers and
floats with each other and nothing else, and every leaf is true or false, also for missing fields.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import InvalidParameter

_ITEM = "tag:string,s:string,i:bigint,d:double,b:boolean"
VALUE = f"struct<{_ITEM},a:array<struct<{_ITEM}>>>"


def tag_of(value: Any) -> str:
    if value is None:
        return "null"
    for kind, tag in ((bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), ((list, tuple), "array")):
        if isinstance(value, kind):
            return tag
    raise InvalidParameter(f"no metadata value: {value!r}")


def encode(value: Any, inner: bool = False) -> dict:
    """A Python value as ``VALUE``; JSON objects become null."""
    value = None if isinstance(value, dict) else value
    tag = tag_of(value)
    out = {"tag": tag, "s": None, "i": None, "d": None, "b": None}
    slot = {"string": "s", "integer": "i", "float": "d", "boolean": "b"}.get(tag)
    if slot:
        out[slot] = value
    return out if inner else out | {"a": [encode(x, True) for x in value] if tag == "array" else None}


def decode_json(text: str | None) -> dict[str, dict]:
    """Metadata of a JSON object; malformed text and anything but an object give none."""
    try:
        got = json.loads(text) if text is not None else None
    except ValueError:
        return {}
    return {k: encode(v if not isinstance(v, int) or isinstance(v, bool) or -(2**63) <= v < 2**63 else float(v)) for k, v in got.items()} if isinstance(got, dict) else {}


class Typed:
    """Fields are columns of a DataFrame; null and missing are the same."""

    def __init__(self, df: DataFrame, prefix: str = ""):
        self.types = {f.name: f.dataType for f in df.schema}
        self.prefix = prefix

    def _tag(self, name: str, kind: T.DataType | None = None) -> str | None:
        kind = kind or self.types.get(name)
        if isinstance(kind, T.BooleanType):
            return "boolean"
        if isinstance(kind, T.IntegralType):
            return "integer"
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return "float"
        return "string" if isinstance(kind, T.StringType) else "array" if isinstance(kind, T.ArrayType) else None

    def _column(self, name: str) -> Column:
        return F.col(f"{self.prefix}`{name}`")

    def present(self, name: str) -> Column:
        return self._column(name).isNotNull() if name in self.types else F.lit(False)

    exists = present

    def equals(self, name: str, value: Any) -> Column:
        if value is None or name not in self.types or self._tag(name) != tag_of(value):
            return F.lit(False)
        c = self._column(name)
        if tag_of(value) == "array":
            inner = self._tag(name, self.types[name].elementType)
            if any(tag_of(x) != inner for x in value):
                return F.lit(False)
            return c == F.array(*(F.lit(x) for x in value)).cast(self.types[name])
        return _also(c == F.lit(value), c, value)

    def among(self, name: str, values: tuple) -> Column | None:
        """One list of values, if all are plain: sources take it as a whole."""
        plain = [x for x in values if name in self.types and self._tag(name) == tag_of(x) in ("string", "integer", "boolean")]
        skipped = all(name not in self.types or self._tag(name) != tag_of(x) for x in values if not any(x is y for y in plain))
        return self._column(name).isin(plain) if plain and skipped else None

    def order(self, name: str, value: Any) -> tuple[Column, Column, Column | None] | None:
        """Both sides of a comparison, and what else must hold."""
        tag = self._tag(name) if name in self.types else None
        mine = tag_of(value)
        if tag in ("integer", "float") and mine in ("integer", "float"):
            if tag == mine == "integer":
                return self._column(name), F.lit(value), None
            c = self._column(name) if tag == "float" else self._column(name).cast("double")
            return c, F.lit(float(value)), ~F.isnan(c) if tag == "float" else None
        return (self._column(name), F.lit(value), None) if tag == mine and tag in ("string", "boolean") else None

    def contains(self, name: str, value: Any) -> Column:
        kind = self.types.get(name)
        if not isinstance(kind, T.ArrayType) or value is None or self._tag(name, kind.elementType) != tag_of(value):
            return F.lit(False)
        return F.exists(self._column(name), lambda x: _also(x == F.lit(value), x, value))

    def starts(self, name: str, prefix: str) -> Column:
        return self._column(name).startswith(prefix) if self._tag(name) == "string" else F.lit(False)


class Tagged:
    """Fields are keys of one ``map<string, VALUE>`` column; an explicit null differs from a missing field."""

    SLOT = {"string": "s", "integer": "i", "float": "d", "boolean": "b"}

    def __init__(self, column: str = "metadata"):
        self.column = column

    def _value(self, name: str) -> Column:
        return F.element_at(F.col(self.column), name)

    def present(self, name: str) -> Column:
        return self._value(name).isNotNull()

    def exists(self, name: str) -> Column:
        return self._value(name)["tag"] != "null"

    def _same(self, v: Column, value: Any) -> Column:
        tag = tag_of(value)
        if tag == "null":
            return v["tag"] == "null"
        if tag == "array":
            items = v["a"]
            return reduce(lambda a, b: a & b, (self._same(F.get(items, F.lit(i)), x) for i, x in enumerate(value)), (v["tag"] == tag) & (F.size(items) == len(value)))
        return (v["tag"] == tag) & _also(v[self.SLOT[tag]] == F.lit(value), v[self.SLOT[tag]], value)

    def equals(self, name: str, value: Any) -> Column:
        return self._same(self._value(name), value)

    def among(self, name: str, values: tuple) -> Column | None:
        return None

    def order(self, name: str, value: Any) -> tuple[Column, Column, Column | None] | None:
        v, tag = self._value(name), tag_of(value)
        if tag == "integer":
            # the wider type only where the field is a float
            exact = F.when(v["tag"] == "integer", v["i"].cast("decimal(38,6)")).when((v["tag"] == "float") & ~F.isnan(v["d"]), v["d"].try_cast("decimal(38,6)"))
            return exact, F.lit(value).cast("decimal(38,6)"), None
        if tag == "float":
            return F.when(v["tag"] == "integer", v["i"].cast("double")).when((v["tag"] == "float") & ~F.isnan(v["d"]), v["d"]), F.lit(value), None
        return (F.when(v["tag"] == tag, v[self.SLOT[tag]]), F.lit(value), None) if tag in ("string", "boolean") else None

    def contains(self, name: str, value: Any) -> Column:
        return F.exists(self._value(name)["a"], lambda x: F.coalesce(self._same(x, value), F.lit(False))) if tag_of(value) != "array" else F.lit(False)

    def starts(self, name: str, prefix: str) -> Column:
        v = self._value(name)
        return (v["tag"] == "string") & v["s"].startswith(prefix)


def _also(same: Column, c: Column, value: Any) -> Column:
    """Excludes NaN, which equals nothing."""
    if not isinstance(value, float):
        return same
    return same & ~F.isnan(c) if value == value else F.lit(False)


@dataclass(frozen=True)
class Condition:
    """``op`` with a field, a value and parts; use the constructors below."""

    op: str
    name: str = ""
    value: Any = None
    parts: tuple = field(default_factory=tuple)

    def __and__(self, other: Condition) -> Condition:
        return all_of(self, other)

    def __or__(self, other: Condition) -> Condition:
        return any_of(self, other)

    def __invert__(self) -> Condition:
        return negate(self)

    def compile(self, fields: Typed | Tagged, negated: bool = False) -> Column:
        """For ``where``: null, which drops a row as false does, is left as it is but below a negation, so sources can
        take the comparison as a pushed filter.
        """
        false, true = F.lit(False), F.lit(True)
        closed = lambda c: F.coalesce(c, false) if negated else c
        op, name, value = self.op, self.name, self.value
        if op == "and":
            return reduce(lambda a, b: a & b, (p.compile(fields, negated) for p in self.parts)) if self.parts else true
        if op == "or":
            return reduce(lambda a, b: a | b, (p.compile(fields, negated) for p in self.parts)) if self.parts else false
        if op == "not":
            return ~self.parts[0].compile(fields, True)
        if op == "eq":
            return closed(fields.equals(name, value))
        if op == "ne":
            return ~F.coalesce(fields.equals(name, value), false)
        if op in ("in", "not_in"):
            got = fields.among(name, value)
            if got is None:
                got = reduce(lambda a, b: a | b, (F.coalesce(fields.equals(name, x), false) for x in value), false)
            return ~F.coalesce(got, false) if op == "not_in" else closed(got)
        if op == "range":
            low, high, with_low, with_high = value
            return closed(_compare(fields, name, low, ">=" if with_low else ">")) & closed(_compare(fields, name, high, "<=" if with_high else "<"))
        if op in (">", ">=", "<", "<="):
            return closed(_compare(fields, name, value, op))
        if op == "contains":
            return closed(fields.contains(name, value))
        if op == "exists":
            return closed(fields.exists(name))
        if op == "is_null":
            return ~F.coalesce(fields.exists(name), false)
        if op == "starts_with":
            return closed(fields.starts(name, value))
        raise InvalidParameter(f"unknown condition {op!r}")

    def fields(self) -> list[str]:
        """Names of fields as they occur, repeats kept."""
        return [x for p in self.parts for x in p.fields()] if self.parts or not self.name else [self.name]

    def to_json(self) -> str:
        def plain(c: Condition) -> dict:
            return {"op": c.op, "name": c.name, "value": c.value, "parts": [plain(p) for p in c.parts]}

        return json.dumps(plain(self))

    @staticmethod
    def from_json(text: str) -> Condition:
        def build(x: dict) -> Condition:
            value = tuple(x["value"]) if isinstance(x["value"], list) else x["value"]
            return Condition(x["op"], x["name"], value, tuple(build(p) for p in x["parts"]))

        try:
            return build(json.loads(text))
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidParameter(f"no condition: {e}") from e


def _compare(fields: Typed | Tagged, name: str, value: Any, op: str) -> Column:
    pair = fields.order(name, value) if value is not None and value == value else None
    if pair is None:
        return F.lit(False)
    a, b, also = pair
    found = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return found if also is None or op in ("<", "<=") else found & also  # NaN sorts last


def eq(name: str, value: Any) -> Condition:
    return Condition("eq", name, value)


def ne(name: str, value: Any) -> Condition:
    return Condition("ne", name, value)


def gt(name: str, value: Any) -> Condition:
    return Condition(">", name, value)


def gte(name: str, value: Any) -> Condition:
    return Condition(">=", name, value)


def lt(name: str, value: Any) -> Condition:
    return Condition("<", name, value)


def lte(name: str, value: Any) -> Condition:
    return Condition("<=", name, value)


def between(name: str, low: Any, high: Any, with_low: bool = True, with_high: bool = True) -> Condition:
    return Condition("range", name, (low, high, with_low, with_high))


def is_in(name: str, values: list) -> Condition:
    return Condition("in", name, tuple(values))


def not_in(name: str, values: list) -> Condition:
    return Condition("not_in", name, tuple(values))


def contains(name: str, value: Any) -> Condition:
    return Condition("contains", name, value)


def exists(name: str) -> Condition:
    return Condition("exists", name)


def is_null(name: str) -> Condition:
    return Condition("is_null", name)


def starts_with(name: str, prefix: str) -> Condition:
    return Condition("starts_with", name, prefix)


def all_of(*parts: Condition) -> Condition:
    return Condition("and", parts=parts)


def any_of(*parts: Condition) -> Condition:
    return Condition("or", parts=parts)


def negate(part: Condition) -> Condition:
    return Condition("not", parts=(part,))

"""Metadata filters: a JSON object compiled to a column predicate over a VARIANT column."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 2048
MOST_KEY = 512
COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
}


class FilterError(ValueError):
    """A filter that can't be compiled."""


def parse(text: str | dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Keys with their operators; a bare value means equality."""
    raw = text if isinstance(text, str) else json.dumps(text)
    if len(raw.encode()) > MOST_BYTES:
        raise FilterError(f"a filter has at most {MOST_BYTES} bytes")
    try:
        tree = json.loads(raw)
    except ValueError as e:
        raise FilterError("a filter is a JSON object") from e
    if tree is None:
        return {}
    if not isinstance(tree, dict):
        raise FilterError("a filter is a JSON object")
    out: dict[str, dict[str, Any]] = {}
    for key, value in tree.items():
        if not key or key.startswith("$") or len(key) > MOST_KEY:
            raise FilterError(f"bad key {key!r}")
        ops = value if isinstance(value, dict) else {"$eq": value}
        if not ops:
            raise FilterError(f"no operator for {key!r}")
        for op, operand in ops.items():
            if op in ("$in", "$nin"):
                if not isinstance(operand, list) or any(isinstance(x, (dict, list)) for x in operand):
                    raise FilterError(f"{op} takes a list of plain values")
            elif op in ("$eq", "$ne", *COMPARISONS):
                if isinstance(operand, (dict, list)):
                    raise FilterError(f"{op} takes a plain value")
            else:
                raise FilterError(f"unknown operator {op!r}")
        out[key] = ops
    return out


def _path(key: str) -> str:
    return "$" + "".join("['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']" for part in key.split("."))


def _printed(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def compile_filter(text: str | dict[str, Any], metadata: Column) -> Column:
    """A predicate, never null. Keys are dotted paths and all must hold.

    Numbers and booleans (0, 1) compare as numbers; other pairs are equal if they print alike, and
    only strings have an order among themselves. A missing key meets `$ne` and `$nin` only; a
    present null equals null.
    """
    whole = [_key(metadata, key, ops) for key, ops in parse(text).items()]
    return reduce(lambda a, b: a & b, whole, F.lit(True))


def _key(metadata: Column, key: str, ops: dict[str, Any]) -> Column:
    value = F.try_variant_get(metadata, _path(key), "variant")
    present = value.isNotNull()
    kind = F.schema_of_variant(value)
    null = F.is_variant_null(value)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double")
    )
    string = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    printed = F.when(~null, F.try_variant_get(value, "$", "string"))

    def equal(x: Any) -> Column:
        if x is None:
            return F.coalesce(null, F.lit(False))
        alike = F.coalesce(printed == _printed(x), F.lit(False))
        if isinstance(x, (bool, int, float)):
            return F.when(number.isNotNull(), number == float(x)).otherwise(alike)
        return alike

    def test(op: str, x: Any) -> Column:
        if op == "$eq":
            return present & equal(x)
        if op == "$ne":
            return ~present | ~equal(x)
        if op == "$in":
            return present & reduce(lambda a, b: a | b, [equal(y) for y in x], F.lit(False))
        if op == "$nin":
            return ~present | ~reduce(lambda a, b: a | b, [equal(y) for y in x], F.lit(False))
        if isinstance(x, str):
            return F.coalesce(COMPARISONS[op](string, F.lit(x)), F.lit(False))
        if isinstance(x, (bool, int, float)):
            return F.coalesce(COMPARISONS[op](number, F.lit(float(x))), F.lit(False))
        return F.lit(False)

    return reduce(lambda a, b: a & b, [F.coalesce(test(op, x), F.lit(False)) for op, x in ops.items()])

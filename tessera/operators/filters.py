"""Metadata predicates: conditions and trees of them, as one column that Spark can push into the scan.

A value that is missing or that cannot be compared fails a comparison of order; an unknown operator lets all rows
pass; an OR of nothing lets none pass, an AND of nothing all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@dataclass(frozen=True)
class Condition:
    key: str
    value: Any
    operator: str = "=="


@dataclass(frozen=True)
class Conditions:
    parts: Sequence[Condition | Conditions] = field(default_factory=tuple)
    any_of: bool = False


def _test(df: DataFrame, c: Condition) -> Column:
    known = c.key in df.columns
    at, kind = (F.col(c.key), df.schema[c.key].dataType) if known else (F.lit(None), StringType())
    op = c.operator.lower()
    if op in ("==", "eq"):
        return at.eqNullSafe(F.lit(c.value)) if known else F.lit(c.value is None)
    if op in ("!=", "ne"):
        return ~at.eqNullSafe(F.lit(c.value)) if known else F.lit(c.value is not None)
    if op in ("in", "nin"):
        hit = F.coalesce(at.isin(*(c.value or [])), F.lit(False)) if known and c.value else F.lit(False)
        return hit if op == "in" else ~hit
    if op in (">", ">=", "<", "<=", "gt", "gte", "lt", "lte"):
        if not known:
            return F.lit(False)
        try:
            target = float(c.value)
        except (TypeError, ValueError):
            return F.lit(False)
        # a numeric column is compared as it is, so that the condition reaches the scan
        a = at.try_cast("double") if isinstance(kind, StringType) else at
        made = {">": a > target, "gt": a > target, ">=": a >= target, "gte": a >= target, "<": a < target, "lt": a < target, "<=": a <= target, "lte": a <= target}
        return F.coalesce(made[op], F.lit(False))
    if op == "contains":
        if not known:
            return F.lit(False)
        if isinstance(kind, ArrayType):
            return F.coalesce(F.array_contains(at, F.lit(c.value)), F.lit(False))
        return F.coalesce(at.contains(c.value), F.lit(False)) if isinstance(kind, StringType) and isinstance(c.value, str) else F.lit(False)
    return F.lit(True)


def predicate(df: DataFrame, tree: Condition | Conditions) -> Column:
    if isinstance(tree, Condition):
        return _test(df, tree)
    tests = [predicate(df, p) for p in tree.parts]
    return reduce((lambda a, b: a | b) if tree.any_of else (lambda a, b: a & b), tests, F.lit(not tree.any_of))

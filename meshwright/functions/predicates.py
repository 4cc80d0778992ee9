"""Predicates as data, turned into Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """A predicate: its name and arguments. Null never satisfies one, but for neq, without and not."""

    name: str
    args: tuple

    def column(self, c: Column, kind: str = "") -> Column:
        """``kind`` is the Spark type of ``c``: equality is strict on types, comparisons cross number types only."""
        a, name = self.args, self.name
        if name in ("and", "or"):
            return reduce(and_ if name == "and" else or_, [p.column(c, kind) for p in a])
        if name == "not":
            return ~a[0].column(c, kind)
        if name in ("within", "without"):
            own = [x for x in a if strict(kind, x)]
            hit = F.coalesce(c.isin(*own), F.lit(False)) if own else F.lit(False)
            return hit if name == "within" else ~hit
        x = a[0]
        if name in ("eq", "neq"):
            hit = F.coalesce(c == F.lit(x), F.lit(False)) if strict(kind, x) else F.lit(False)
            return hit if name == "eq" else ~hit
        if name in ("gt", "gte", "lt", "lte"):
            if not loose(kind, x):
                return F.lit(False)
            v = F.lit(x)
            return F.coalesce({"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[name], F.lit(False))
        if kind and kind != "string":
            return F.lit(False)
        hit = {"containing": c.contains, "startingWith": c.startswith, "endingWith": c.endswith, "matching": c.rlike}[name](x)
        return F.coalesce(hit, F.lit(False))


NAMES = ("eq", "neq", "gt", "gte", "lt", "lte", "within", "without", "containing", "startingWith", "endingWith", "matching", "and", "or", "not")
WHOLE, PART = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def strict(kind: str, x: object) -> bool:
    if not kind:
        return True
    if isinstance(x, bool):
        return kind == "boolean"
    if isinstance(x, int):
        return kind in WHOLE
    if isinstance(x, float):
        return kind in PART
    return kind == "string" if isinstance(x, str) else True


def loose(kind: str, x: object) -> bool:
    if not kind:
        return True
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return kind in WHOLE + PART or kind.startswith("decimal")
    return strict(kind, x) or (isinstance(x, str) and kind.startswith("timestamp"))


def predicate(name: str):
    return lambda *args: P(name, args)


eq, neq, gt, gte, lt, lte, within, without, containing, startingWith, endingWith, matching, and_p, or_p, not_p = map(predicate, NAMES)


# Predicates of the native engine on a vertex row; ``degree`` is a column of the row.
def property_equals(k, v):
    return F.coalesce(F.col(k) == F.lit(v), F.lit(False))


def property_not_equals(k, v):
    return ~F.col(k).eqNullSafe(F.lit(v))


def property_range(k, low=None, high=None):
    tests = [F.col(k) >= F.lit(low)] * (low is not None) + [F.col(k) <= F.lit(high)] * (high is not None)
    return F.coalesce(reduce(and_, tests, F.col(k).isNotNull()), F.lit(False))


def property_greater(k, v):
    return F.coalesce(F.col(k) > F.lit(v), F.lit(False))


def property_less(k, v):
    return F.coalesce(F.col(k) < F.lit(v), F.lit(False))


def vertex_in(ids):
    return F.col("id").isin(*ids)


def degree_greater(n):
    return F.col("degree") > n


def degree_less(n):
    return F.col("degree") < n


def property_exists(k):
    return F.col(k).isNotNull()


def degree_range(low, high):
    return F.col("degree").between(low, high)

"""Results as strings, as JSON and as report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def strings(result, paths: bool = False) -> DataFrame:
    """One column ``text``: v[1], e[1], values as they are, null, and [a, b] for lists and, if ``paths``, [v[1], v[2]] for paths."""
    df = result.df
    if result.kind in ("vertex", "edge"):
        text = F.format_string(f"{result.kind[0]}[%d]", "id" if result.kind == "vertex" else "eid")
    elif paths:
        text = listed(F.transform(df.columns[0], lambda v: F.format_string("v[%d]", v)))
    else:
        column = df.columns[0]
        kind = dict(df.dtypes)[column]
        text = listed(F.transform(column, lambda v: F.coalesce(v.cast("string"), F.lit("null")))) if kind.startswith("array") else F.col(column).cast("string")
    return df.select(F.coalesce(text, F.lit("null")).alias("text"))


def element(kind: str, number: Column) -> Column:
    return F.struct(number.alias("id"), F.lit(kind).alias("type"))


def json(result, paths: bool = False, count: bool = False) -> DataFrame:
    """One column ``json``: objects with a type for elements, tables' rows and, if asked, paths and counts; values as they are."""
    df = result.df
    if result.kind in ("vertex", "edge"):
        out = F.to_json(element(result.kind, F.col("id" if result.kind == "vertex" else "eid")))
    elif paths:
        out = F.to_json(F.struct(F.transform(df.columns[0], lambda v: element("vertex", v)).alias("elements"), F.lit("path").alias("type")))
    elif count:
        out = F.to_json(F.struct(F.lit("count").alias("type"), F.col(df.columns[0]).alias("value")))
    elif len(df.columns) > 1:
        out = F.to_json(F.struct(F.lit("map").alias("type"), F.struct(*df.columns).alias("value")))
    else:
        body = F.to_json(F.array(df.columns[0]))
        out = F.substring(body, F.lit(2), F.length(body) - 2)
    return df.select(out.alias("json"))


def report(metrics: DataFrame, form: str) -> DataFrame:
    """Lines of a report: json and csv of each row, or prometheus, one ``column value`` line for each number of each row."""
    if form == "prometheus":
        numbers = [c for c, kind in metrics.dtypes if kind in ("int", "bigint", "double", "float")]
        lines = F.explode(F.array(*[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in numbers]))
    else:
        lines = {"json": F.to_json, "csv": F.to_csv}[form](F.struct(*metrics.columns))
    return metrics.select(lines.alias("line"))

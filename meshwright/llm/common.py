"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.settle import settle

#: Cuts lineage by a table written in the shared folder.
cut = settle

#: A word is a run of anything but these six ASCII white-space characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spread_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores behind it the first name that no column has (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def quoted(columns: list[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_of(column: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def values(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Rows of strings and numbers as a local relation, whose exact size the planner knows."""

    def lit(x: object) -> str:
        if x is None:
            return "CAST(NULL AS STRING)"
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{x!r}D" if isinstance(x, float) else repr(x)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def running(array: Column, merge, zero: Column, chunk: int = 256) -> Column:
    """Running totals (sum, maximum) of an array, each with its own element included.

    Spark has no scan over an array, so totals are taken in chunks: totals of
    whole chunks first, then within each chunk, which keeps the work near n * chunk.
    """
    def totals(a: Column) -> Column:
        n = F.size(a)
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / chunk), F.lit(0)).cast("int"))
        per = F.transform(chunks, lambda c: F.aggregate(F.slice(a, c * chunk + 1, chunk), zero, merge))

        def inside(before: Column, i: Column) -> Column:
            c = F.floor(i / chunk).cast("int")
            return F.aggregate(F.slice(a, c * chunk + 1, i - c * chunk + 1), F.get(before, c), merge)

        def each(before: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: inside(before, i))

        behind = let(per, lambda p: F.transform(chunks, lambda c: F.aggregate(F.slice(p, 1, c), zero, merge)))
        return F.when(n > 0, let(behind, each)).otherwise(F.slice(a, 1, 0))

    return let(array, totals)

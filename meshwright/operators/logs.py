"""Update logs: last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(log: DataFrame, keys: list[str], values: list[str] = (), at: int | None = None, gone: str = "del") -> DataFrame:
    """Current rows of a log with op, ts and seq: the newest entry for each key, unless it deletes.

    max_by keeps one entry a key on the map side, so only keys shuffle, not versions. ``at`` reads the past: ts <= at.
    """
    rows = log if at is None else log.where(F.col("ts") <= at)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("op", *values), F.struct("ts", "seq")).alias("last"))
    return last.where(F.col("last.op") != gone).select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def versions(log: DataFrame, condition) -> DataFrame:
    return log.where(condition).orderBy(F.desc("ts"), F.desc("seq"))


def compact(log: DataFrame, keys: list[str], values: list[str] = ()) -> DataFrame:
    """The log with the newest entry for each key only, deletes included."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("op", "ts", "seq", *values), F.struct("ts", "seq")).alias("last"))
    return last.select(*keys, "last.*")

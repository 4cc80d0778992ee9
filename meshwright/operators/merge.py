"""Merging the results of range partitions, one frame of like columns each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def ordered(parts: list[DataFrame], *by: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct().orderBy(*by)


def unordered(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union(parts: list[DataFrame]) -> DataFrame:
    return unordered(parts).distinct()


def intersection(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, parts)

"""Mixing sources to target weights by a time-varying curriculum (native).

Each source has a weight and a schedule, a piecewise linear rate over training
time 0 to 1 that integrates to 1. Its token target is its share of the budget,
held to ``max_epochs`` times its own size, the excess reshared by weight. The
cumulative demand of a source at time t is target times the integral of its
schedule up to t. Documents stand in a hashed order along their source's demand,
epoch after epoch; inverting the demand at a copy's middle word gives its
position in training, and the mix is range-sorted by position.

A source is never walked in one task: words are summed by (source, hash bucket),
running totals are taken over buckets, then inside each bucket. Rows are placed
without their texts: equal rows are one slim row with a count, told by 128 bits of
hash over all columns, and the texts join the placed rows once, on their way to the
range sort.

Defined cases: a null or empty text has no words, is taken 0 times and has no
position; a null source is a source of its own, last in order; repeated rows are
documents of their own, placed one behind the other; an empty table gives an empty
mix; other columns, whatever their names, travel along. At most one copy in a source
is taken in part, where the demand ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import WORD, cut, quoted, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Fixed values: (time, rate) knots of the schedules dealt with the weights: early, even, late.
SCHEDULES = (((0.0, 1.4), (0.5, 1.1), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.1), (1.0, 1.4)))
LEAST_BUCKETS, MOST_BUCKETS, ROWS_PER_BUCKET = 1024, 65536, 20_000


def integrate(knots: tuple[tuple[float, float], ...]) -> list[dict[str, float]]:
    """The schedule's segments with the area before each, scaled to a whole area of 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for (t, r), (u, s) in zip(knots, knots[1:], strict=False):
        out.append({"t": t, "rate": r / area, "slope": (s - r) / (u - t) / area, "before": before})
        before += (u - t) * (r + s) / 2 / area
    return out


def invert(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches ``share``."""
    at: Column = F.lit(None).cast("double")
    for s in integrate(knots):  # the last segment that begins at or below the share
        rest = F.greatest(share - s["before"], F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(s["rate"] ** 2) + 2 * s["slope"] * rest, F.lit(0.0)))
        time = s["t"] + 2 * rest / F.greatest(s["rate"] + root, F.lit(1e-12))
        at = F.when(share >= s["before"], time).otherwise(at)
    return F.least(at, F.lit(1.0))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, kind): one row a source; few rows, so the ordering windows have one partition."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    kind = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("kind") + 1).cast("int"))
    rows = by.withColumn("kind", kind).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    # Sources fill up in the order of cap / weight; up to the first that doesn't, each one's target is its cap.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), final["level"] * F.col("weight")))).select("source", "source_size", "target", "kind")


def size_of(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def same_source(a: str, b: str) -> Column:
    """An equi-join on a source that may be null."""
    return (F.coalesce(F.col(f"{a}.source"), F.lit("")) == F.coalesce(F.col(f"{b}.source"), F.lit(""))) & (F.isnull(f"{a}.source") == F.isnull(f"{b}.source"))


def placed(rows: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows``, distinct (a, b, key, source, size, copies), each with source_size, target and, for each of its copies, taken and visits (epoch, words, position)."""
    rows = cut(rows.withColumn("mixed", F.xxhash64(F.col("key").cast("string"), "size", "source", F.lit("mix"))).withColumn("words", F.col("size") * F.col("copies")), "mix")
    count = rows.count()
    buckets = 2 ** min(int(math.log2(MOST_BUCKETS)), max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, count / ROWS_PER_BUCKET)))))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("mixed", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shares = targets(rows.select("source", F.col("words").alias("size")), weights, budget, max_epochs)
    sums = sums.alias("a").join(shares.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "bucket", "before", "source_size", "target", "kind")
    rows = rows.alias("x").join(sums.alias("y"), same_source("x", "y") & (F.col("x.bucket") == F.col("y.bucket"))).select("x.*", "before", "source_size", "target", "kind")
    inside = Window.partitionBy(F.coalesce("source", F.lit("")), F.isnull("source"), "bucket").orderBy("mixed", "key", "size", "a", "b").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    rows = rows.withColumn("first", first).withColumn("demand", F.floor(F.col("target") + 1e-6))

    def visits(copy: Column) -> Column:
        start = F.col("first") + copy * F.col("size")

        def visit(e: Column) -> Column:
            behind = start + e * F.col("source_size")
            words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - behind)).cast("long")
            share = (behind + words / 2) / F.greatest("target", F.lit(1e-12))
            at: Column = F.lit(None).cast("double")
            for k, knots in enumerate(schedules):
                at = F.when(F.col("kind") % len(schedules) == k, invert(share, knots)).otherwise(at)
            return F.struct(e.alias("epoch"), words.alias("words"), at.alias("position"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), visit), lambda v: v["words"] > 0)

    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("visits", visits(F.col("copy")))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda acc, v: acc + v["words"])
    return rows.select("a", "b", "key", "source", "size", "source_size", "target", taken.alias("taken"), "visits")


def place(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """(key, source, size, source_size, target, taken, visits), one row for each row of ``docs``."""
    k = F.col(quoted([key])[0])
    rows = docs.select(k.alias("key"), F.col(quoted([source])[0]).alias("source"), size_of(quoted([text])[0]).alias("size"))
    rows = rows.groupBy("key", "source", "size").agg(F.count("*").alias("copies"))
    out = placed(rows.withColumn("a", F.lit(0)).withColumn("b", F.lit(0)), **options)
    return out.select("key", "source", "size", "source_size", "target", "taken", "visits")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), 1, n.cast("int")), "")


def identity(docs: DataFrame) -> list[Column]:
    """128 bits, as columns a and b, that tell rows apart by all their columns."""
    parts = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, (_, kind) in zip(quoted(docs.columns), docs.dtypes, strict=True)]
    nulls = [F.isnull(c) for c in quoted(docs.columns)]  # a hash passes over nulls
    return [F.xxhash64(F.lit(1), *parts, *nulls).alias("a"), F.xxhash64(F.lit(2), *nulls, *parts).alias("b")]


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The training mix: the columns of ``docs``, one row for each copy taken, in training order."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(docs.columns))])
    told = docs.select(*identity(docs), F.col(quoted([key])[0]).alias("key"), F.col(quoted([source])[0]).alias("source"), F.col(quoted([text])[0]).alias("text"), row.alias("row"))
    slim = told.groupBy("a", "b", "key", "source", size_of("text").alias("size")).agg(F.count("*").alias("copies"))
    visits = placed(slim, **options).select("a", "b", "size", F.explode("visits").alias("v"))
    # Equal rows are one before the shuffle; each text goes to its visits, then to its place.
    held = told.groupBy("a", "b").agg(F.first("row").alias("row"))
    rows = held.join(visits, ["a", "b"]).select("row", "size", "v.words", "v.position", "v.epoch")

    def column(i: int, name: str) -> Column:
        c = F.col(f"row.c{i}")
        if name.lower() == text.lower():
            c = F.when(F.col("words") >= F.col("size"), c).otherwise(first_words(text_of(c), F.col("words")))
        return c.alias(f"c{i}")

    rows = rows.select("position", "epoch", *[column(i, c) for i, c in enumerate(docs.columns)]).orderBy("position", "epoch")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""The update cost model, degree sketch and latency histogram, as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    id_bytes: float = 8.0
    size_ratio: float = 10.0
    levels: float = 4.0
    block_bytes: float = 4096.0
    lookups: float = 0.5
    updates: float = 0.5


def delta_cost(degree: Column, c: Config = Config()) -> Column:
    return F.lit(2 * c.id_bytes * c.size_ratio * c.levels / c.block_bytes) + degree * (c.lookups / (c.updates * (c.size_ratio - 1)))


def pivot_cost(degree: Column, c: Config = Config()) -> Column:
    return 2 + (degree + 1) * (c.id_bytes / c.block_bytes) + (degree + 2) * (c.id_bytes * c.size_ratio * c.levels / c.block_bytes)


def method(degree: Column, threshold: int = 155) -> Column:
    return F.when(degree >= threshold, "delta").otherwise("pivot")


def workload(lookups: Column, total: Column) -> Column:
    share = F.when(total > 0, lookups / total).otherwise(0.0)
    return F.when(share > 0.7, "ReadHeavy").when(share < 0.3, "WriteHeavy").otherwise("Balanced")


def morris_estimate(exponent: Column, mantissa: Column) -> Column:
    return (F.pow(F.lit(2.0), exponent) - 1) * 16 + F.pow(F.lit(2.0), exponent) * mantissa


def morris_error(exponent: Column) -> Column:
    return 1.04 / F.sqrt(F.pow(F.lit(2.0), exponent))


def sketch(degrees: DataFrame, cells: int) -> DataFrame:
    """(cell, exponent, mantissa): the degrees (id, degree), added up by hashed cell, as counters with 4 bits of mantissa.

    A counter here holds the greatest state whose estimate is at most the exact sum, where counters of a write path move at
    random. Cells without a degree have no row.
    """
    sums = degrees.groupBy(F.pmod("id", F.lit(cells)).alias("cell")).agg(F.sum("degree").alias("n")).where("n > 0")
    power = (F.length(F.bin(F.floor(F.col("n") / 16) + 1)) - 1).cast("long")  # the whole part of log2, exact at powers of 2
    held = sums.withColumn("exponent", power).withColumn("scale", F.pow(F.lit(2.0), "exponent").cast("long"))
    return held.select("cell", "exponent", F.floor((F.col("n") - (F.col("scale") - 1) * 16) / F.col("scale")).alias("mantissa"))


def sketch_statistics(held: DataFrame, cells: int) -> DataFrame:
    """One row on a sketch: active cells, sum, highest, lowest and mean estimate of those, mean relative error.

    A cell without a degree adds its error of 1.04 to the sum that is divided by the active cells.
    """
    n, error = morris_estimate(F.col("exponent"), F.col("mantissa")), morris_error(F.col("exponent"))
    seen = held.agg(F.count("*").alias("active"), F.sum(n).alias("total"), F.max(n).alias("highest"), F.min(n).alias("lowest"), F.sum(error).alias("error"))
    share = lambda x: F.when(F.col("active") > 0, x / F.col("active")).otherwise(0.0)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "highest", "lowest")]
    idle = (F.lit(cells) - F.col("active")) * 1.04
    return seen.select("active", *zero, share(F.col("total")).alias("mean"), share(F.col("error") + idle).alias("mean_error"))


def optimal_ratio(average_degree: Column, c: Config = Config(), id_bytes: float = 1.0) -> Column:
    """Lookups per update at which both update methods cost the same; 1 without degrees."""
    top = (c.size_ratio - 1) * ((average_degree + 2) * (id_bytes * c.size_ratio * c.levels) + 2 * c.block_bytes)
    return F.when(average_degree == 0, 1.0).otherwise(top / F.greatest(average_degree * c.block_bytes, F.lit(1e-300)))


def degree_threshold(lookups: Column, updates: Column, average_degree: Column, c: Config = Config(), id_bytes: float = 1.0) -> Column:
    """The degree from which a delta update is cheaper, a whole number; 0 without updates."""
    spread = c.size_ratio * c.levels + 1
    first = lookups * average_degree * c.block_bytes / F.greatest(updates * (id_bytes * (c.size_ratio - 1) * spread), F.lit(1e-300))
    least = first - 2 * c.block_bytes / (id_bytes * spread) - 1 / spread
    return F.when(updates == 0, F.lit(0).cast("long")).otherwise(F.floor(F.greatest(least, F.lit(0.0))))


def trend(overall: Column, recent: Column) -> Column:
    """How the share of lookups among recent operations differs from that among all."""
    more = recent - overall
    return F.when(F.abs(more) < 0.05, "Stable").when(F.abs(more) > 0.3, "Volatile").when(more > 0, "IncreasingReads").otherwise("IncreasingWrites")


#: Upper bounds of the latency histogram in milliseconds, and what stands for all above.
BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0)
ABOVE = 5000.0


def slot(latency: Column) -> Column:
    """The number of the bucket, len(BOUNDS) for values above all bounds."""
    out = F.lit(len(BOUNDS))
    for i, b in reversed(list(enumerate(BOUNDS))):
        out = F.when(latency <= b, i).otherwise(out)
    return out


def bucket(latency: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*BOUNDS, ABOVE))), slot(latency) + 1)


def percentiles(rows: DataFrame, latency: str, shares: list[float]) -> DataFrame:
    """(share, latency): the bound of the first bucket up to which the whole part of ``share`` percent of the rows lies; 0 without rows."""
    counts = rows.where(F.col(latency).isNotNull()).groupBy(slot(F.col(latency)).alias("slot"), bucket(F.col(latency)).alias("bound")).agg(F.count("*").alias("n"))
    # At most one row a bucket.
    ordered = counts.withColumn("upto", F.sum("n").over(Window.orderBy("slot"))).withColumn("total", F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # A share so small that no whole row belongs to it is met by the first bucket, empty or not.
    firsts = [F.when(F.floor(F.lit(p) / 100 * F.max("total")) == 0, BOUNDS[0]).otherwise(F.min(F.when(F.col("upto") >= F.floor(F.lit(p) / 100 * F.col("total")), F.col("bound")))) for p in shares]
    one = ordered.agg(*[F.coalesce(f, F.lit(0.0)).alias(f"p{i}") for i, f in enumerate(firsts)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), F.col(f"p{i}").alias("latency")) for i, p in enumerate(shares)])).alias("e")).select("e.*")

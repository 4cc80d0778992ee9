"""The engine query: a filter, then a projection, or else global aggregates, or else vertex ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def aggregate(rows: DataFrame, wanted: list[tuple[str, ...]]) -> DataFrame:
    """One row of ("count",) and of ("sum" | "avg" | "min" | "max" | "distinct", property), named count, sum_<property> and so on.

    Sums and averages skip nulls and are 0.0 without numbers, as they are for properties that hold no numbers;
    least and greatest values of any type are null without values.
    """
    kinds = dict(rows.dtypes)

    def one(how: str, key: str | None = None) -> Column:
        if how == "count":
            return F.count("*").alias("count")
        if key not in kinds:
            return (F.lit(None) if how in ("min", "max") else F.lit(0).cast("long") if how == "distinct" else F.lit(0.0)).alias(f"{how}_{key}")
        c = F.col(f"`{key}`")
        if how in ("sum", "avg"):
            number = c.cast("double") if kinds[key].startswith(NUMBERS) else F.lit(None).cast("double")
            return F.coalesce(F.sum(number) if how == "sum" else F.avg(number), F.lit(0.0)).alias(f"{how}_{key}")
        return {"min": F.min, "max": F.max, "distinct": F.countDistinct}[how](c).alias(f"{how}_{key}")

    return rows.agg(*[one(*w) for w in wanted])


def execute(graph, where: Column | None = None, project: list[str] | None = None, aggregates: list[tuple[str, ...]] | None = None, vertices: DataFrame | None = None, degrees: bool = False) -> DataFrame:
    """``where`` may name properties, id, label and, with ``degrees``, degree; ``project`` takes the same names and vertex_id."""
    rows = graph.vertices if vertices is None else vertices
    if degrees:
        rows = rows.join(graph.degrees(), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    if where is not None:
        rows = rows.where(where)
    if aggregates and not project:
        return aggregate(rows, aggregates)
    rows = rows.withColumn("vertex_id", F.concat(F.lit("v"), F.col("id")))
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).alias(c) for c in (project or ["vertex_id"])])


class Cache:
    """Results of queries by text, kept by Spark until the oldest give way."""

    def __init__(self, graph, most: int = 10_000) -> None:
        self.graph, self.most, self.held, self.accesses = graph, most, {}, 0

    def query(self, text: str) -> DataFrame:
        self.accesses += 1
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).unpersist()
            self.held[text] = self.graph.query(text).df.persist()
        return self.held[text]

    def stats(self) -> dict[str, int]:
        return {"total_entries": len(self.held), "max_size": self.most, "total_accesses": self.accesses}

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

"""The property graph: one vertex table, one labelled edge table, both DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """Immutable; a mutation returns a new graph.

    ``vertices``: id, label and a column for each property. ``edges``: eid, src, dst, label and properties; a labelled
    multigraph. A missing property is null.
    """

    vertices: DataFrame
    edges: DataFrame
    finder: Callable[[list[int]], DataFrame] | None = None  #: of a source that can look vertices up by id without a full scan

    def lookup(self, ids: list[int]) -> DataFrame:
        """The vertices with these ids."""
        return self.vertices.where(F.col("id").isin(*ids)) if self.finder is None else self.finder(ids)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @cached_property
    def adj(self) -> DataFrame:
        """The simple-graph view: distinct (src, dst)."""
        return self.edges.select("src", "dst").distinct()

    def pairs(self, *labels: str) -> DataFrame:
        """Distinct (src, dst) among the labels; all edges without labels."""
        edges = self.edges.where(F.col("label").isin(*labels)) if labels else self.edges
        return edges.select("src", "dst").distinct()

    def subgraph(self, *labels: str) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where(F.col("label").isin(*labels)), self.finder)

    @cached_property
    def vertex_keys(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in ("id", "label")]

    @cached_property
    def edge_keys(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("eid", "src", "dst", "label")]

    @property
    def g(self):
        from meshwright.plans.traversal import Traversal

        return Traversal(self, ())

    def query(self, text: str):
        """Compile query text to a result with a lazy DataFrame."""
        from meshwright.plans.compiler import compile_steps
        from meshwright.plans.parser import parse

        return compile_steps(self, parse(text))

    # Point and range lookups, each pushed down to the scan of the table.
    def neighbors(self, v: int) -> DataFrame:
        return self.adj.where(F.col("src") == v).select("dst")

    def has_edge(self, s: int, t: int) -> DataFrame:
        return self.edges.where((F.col("src") == s) & (F.col("dst") == t)).agg((F.count("*") > 0).alias("found"))

    def degrees(self) -> DataFrame:
        return self.vertices.select("id").join(self.adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def id_range(self, a: int, b: int) -> DataFrame:
        """Sources of edges with ids in [a, b]."""
        return self.edges.where(F.col("src").between(a, b)).select(F.col("src").alias("id")).distinct()

    def find(self, key: str, value) -> DataFrame:
        return self.vertices.where(F.col(key) == F.lit(value)).select("id")

    def find_range(self, key: str, low, high) -> DataFrame:
        return self.vertices.where(F.col(key).between(F.lit(low), F.lit(high))).select("id")

    def outgoing(self, v: int, label: str | None = None) -> DataFrame:
        return self.edges.where((F.col("src") == v) & (F.lit(True) if label is None else F.col("label") == label))

    def outgoing_of(self, ids: DataFrame, label: str) -> DataFrame:
        """The edges of one label that begin at ``ids``, a column ``src``."""
        return self.edges.where(F.col("label") == label).join(ids, "src", "left_semi")

    def incoming(self, v: int, label: str | None = None) -> DataFrame:
        return self.edges.where((F.col("dst") == v) & (F.lit(True) if label is None else F.col("label") == label))

    def property_keys(self) -> DataFrame:
        """(key, n): property keys with a value somewhere, from one pass of counts."""
        keys = self.vertex_keys
        counts = self.vertices.agg(*[F.count(k).alias(k) for k in keys])
        return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in keys])).alias("e")).select("e.*").where("n > 0")

    def profile(self, key: str) -> DataFrame:
        """(key, type, n, distinct): a property's type, number of values and of distinct values."""
        kind = dict(self.vertices.dtypes)[key]
        return self.vertices.agg(F.lit(key).alias("key"), F.lit(kind).alias("type"), F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct"))

    def samples(self, key: str, limit: int = 10) -> DataFrame:
        """(id, value): the first values of a property, by id."""
        return self.vertices.where(F.col(key).isNotNull()).select("id", F.col(key).alias("value")).orderBy("id").limit(limit)

    def edge_properties(self, eid: int, *keys: str) -> DataFrame:
        """One row with an edge's properties; no row if there is no such edge, null for a property that it lacks."""
        own = [F.col(k) if k in self.edge_keys else F.lit(None).cast("string").alias(k) for k in keys or self.edge_keys]
        return self.edges.where(F.col("eid") == eid).select("eid", *own)

    # Mutations.
    def add_vertices(self, rows: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices.unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.unionByName(rows, allowMissingColumns=True), self.finder)

    def register_edges(self, rows: DataFrame) -> PropertyGraph:
        """With these edges, each of which takes the place of the one with its eid. ``rows`` has each eid once."""
        rest = self.edges.join(rows.select("eid"), "eid", "left_anti").select(*self.edges.columns)
        return PropertyGraph(self.vertices, rest.unionByName(rows, allowMissingColumns=True), self.finder)

    def delete_vertices(self, ids: DataFrame) -> PropertyGraph:
        gone = ids.select("id")
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.vertices.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def set_property(self, ids: DataFrame, key: str, value) -> PropertyGraph:
        return self.set_properties(ids, {key: value})

    def set_properties(self, ids: DataFrame, values: dict) -> PropertyGraph:
        """With these properties on these vertices; their other properties stay."""
        hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
        rows = self.vertices.join(hit, "id", "left")
        for key, value in values.items():
            old = F.col(key) if key in self.vertices.columns else F.lit(None)
            rows = rows.withColumn(key, F.when(F.col("__hit"), F.lit(value)).otherwise(old))
        return PropertyGraph(rows.drop("__hit"), self.edges)

    def set_edge_property(self, eids: DataFrame, key: str, value) -> PropertyGraph:
        hit = eids.select("eid").distinct().withColumn("__hit", F.lit(True))
        old = F.col(key) if key in self.edges.columns else F.lit(None)
        rows = self.edges.join(hit, "eid", "left").withColumn(key, F.when(F.col("__hit"), F.lit(value)).otherwise(old)).drop("__hit")
        return PropertyGraph(self.vertices, rows, self.finder)

    def delete_properties(self, ids: DataFrame, *keys: str) -> PropertyGraph:
        """Without these properties on these vertices; keys that the graph lacks are passed over."""
        hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
        rows = self.vertices.join(hit, "id", "left")
        for k in keys:
            if k in self.vertex_keys:
                rows = rows.withColumn(k, F.when(F.col("__hit").isNull(), F.col(k)))
        return PropertyGraph(rows.drop("__hit"), self.edges)

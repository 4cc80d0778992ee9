"""The graph view over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.graph import PropertyGraph
from meshwright.settle import settle

CODES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "user": 7}
SCALE = 10**9
EDGE_CODES = {"in_region": 1, "in_nation": 2, "placed": 3, "contains": 4, "supplies": 5, "purchased": 6, "follows": 7, "next": 8}
EDGE_SCALE = 10**12


def vid(label: str, key: str | Column) -> Column:
    return (F.lit(CODES[label] * SCALE) + F.col(key).cast("long")) if isinstance(key, str) else F.lit(CODES[label] * SCALE) + key


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lead(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with next_<value>, the value of the next row in order, without gathering all rows in one task.

    Rows are range-partitioned, each partition looks ahead by itself, and the first row of each partition, one row a
    partition, closes the gap to the one before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    inside = Window.partitionBy("__p").orderBy(*order)
    rows = rows.withColumn("__next", F.lead(value).over(inside))
    firsts = rows.groupBy("__p").agg(F.min(F.struct(*order, value)).alias("f"))
    follow = firsts.select("__p", F.lead(f"f.{value}").over(Window.orderBy("__p")).alias("__first"))
    return rows.join(F.broadcast(follow), "__p").withColumn(f"next_{value}", F.coalesce("__next", "__first")).drop("__p", "__next", "__first")


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, src, dst) between raw customer keys: each order's customer follows the next order's."""
    rows = lead(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey")
    return rows.where("next_o_custkey IS NOT NULL").select(F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("src"), F.col("next_o_custkey").alias("dst"))


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lead(read(spark, sf_dir, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "user_id")
    return rows.where("next_user_id IS NOT NULL").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), F.col("next_user_id").alias("dst"))


def load(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] | None = None) -> PropertyGraph:
    """The graph. ``labels`` limits the edge labels; nothing is read for those left out."""

    def t(name: str) -> DataFrame:
        return read(spark, sf_dir, name)

    def of(name: str, key: str, *columns) -> Callable[[list[int] | None], DataFrame]:
        def make(some: list[int] | None) -> DataFrame:
            rows = t(name)
            if some is not None:
                rows = rows.where(F.col(key).isin(*some) if some else F.lit(False))
            out = rows.select(*columns)
            return out.distinct() if name == "events" else out

        return make

    v = {
        "region": of("region", "r_regionkey", vid("region", "r_regionkey").alias("id"), F.lit("region").alias("label"), "r_name"),
        "nation": of("nation", "n_nationkey", vid("nation", "n_nationkey").alias("id"), F.lit("nation").alias("label"), "n_name"),
        "customer": of("customer", "c_custkey", vid("customer", "c_custkey").alias("id"), F.lit("customer").alias("label"), "c_name", "c_acctbal", "c_mktsegment"),
        "supplier": of("supplier", "s_suppkey", vid("supplier", "s_suppkey").alias("id"), F.lit("supplier").alias("label"), "s_name", "s_acctbal"),
        "part": of("part", "p_partkey", vid("part", "p_partkey").alias("id"), F.lit("part").alias("label"), "p_name", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), "p_retailprice"),
        "order": of("orders", "o_orderkey", vid("order", "o_orderkey").alias("id"), F.lit("order").alias("label"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "user": of("events", "user_id", vid("user", "user_id").alias("id"), F.lit("user").alias("label")),
    }
    def together(frames: list[DataFrame]) -> DataFrame:
        table = frames[0]
        for more in frames[1:]:
            table = table.unionByName(more, allowMissingColumns=True)
        return table

    def find(ids: list[int]) -> DataFrame:
        """Each table by its own keys, so that the test reaches its scan; tables without a key among the ids aren't read."""
        return together([v[label]([i - code * SCALE for i in ids if i // SCALE == code]) for label, code in CODES.items()])

    table = together([make(None) for make in v.values()])

    def edge(label: str, key: Column, src: Column, dst: Column) -> list[Column]:
        return [(F.lit(EDGE_CODES[label] * EDGE_SCALE) + key).alias("eid"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label")]

    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    line = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"), F.lit(EDGE_SCALE))
    makers = {
        "in_region": lambda: [t("nation").select(*edge("in_region", F.col("n_nationkey").cast("long"), vid("nation", "n_nationkey"), vid("region", "n_regionkey")))],
        "in_nation": lambda: [
            t("customer").select(*edge("in_nation", F.col("c_custkey"), vid("customer", "c_custkey"), vid("nation", "c_nationkey"))),
            t("supplier").select(*edge("in_nation", F.col("s_suppkey") + EDGE_SCALE // 2, vid("supplier", "s_suppkey"), vid("nation", "s_nationkey"))),
        ],
        "placed": lambda: [t("orders").select(*edge("placed", F.col("o_orderkey"), vid("customer", "o_custkey"), vid("order", "o_orderkey")))],
        "contains": lambda: [t("lineitem").select(*edge("contains", line, vid("order", "l_orderkey"), vid("part", "l_partkey")), "l_quantity", "l_extendedprice", "l_discount")],
        "supplies": lambda: [t("lineitem").select("l_suppkey", "l_partkey").distinct().select(*edge("supplies", F.pmod(F.xxhash64("l_suppkey", "l_partkey"), F.lit(EDGE_SCALE)), vid("supplier", "l_suppkey"), vid("part", "l_partkey")))],
        "purchased": lambda: [t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(*edge("purchased", line, vid("customer", "o_custkey"), vid("part", "l_partkey")), money.alias("amount"), F.col("l_quantity").alias("quantity"))],
        "follows": lambda: [follows(spark, sf_dir).select(*edge("follows", F.col("eid"), vid("customer", "src"), vid("customer", "dst")))],
        "next": lambda: [next_events(spark, sf_dir).select(*edge("next", F.col("eid"), vid("user", "src"), vid("user", "dst")))],
    }
    frames = [f for label in (makers if labels is None else labels) for f in makers[label]()]
    edges = frames[0]
    for more in frames[1:]:
        edges = edges.unionByName(more, allowMissingColumns=True)
    return PropertyGraph(table, edges, find)

"""The catalogue of graph queries, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import predicates as p
from meshwright.operators import algorithms as alg
from meshwright.operators import costmodel as cost
from meshwright.operators import logs
from meshwright.sources.tables import load, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

C, S, PT, O, U = 3_000_000_000, 4_000_000_000, 5_000_000_000, 6_000_000_000, 7_000_000_000
FM = f"fm AS (SELECT * FROM (SELECT 7000000000000 + o_orderkey AS eid, {C} + o_custkey AS src, {C} + lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
FD = FM + ", f AS (SELECT DISTINCT src, dst FROM fm)"
VS = f"""v AS (SELECT 1000000000 + r_regionkey AS id, 'region' AS label FROM region UNION ALL SELECT 2000000000 + n_nationkey, 'nation' FROM nation
 UNION ALL SELECT {C} + c_custkey, 'customer' FROM customer UNION ALL SELECT {S} + s_suppkey, 'supplier' FROM supplier UNION ALL SELECT {PT} + p_partkey, 'part' FROM part
 UNION ALL SELECT {O} + o_orderkey, 'order' FROM orders UNION ALL SELECT DISTINCT {U} + user_id, 'user' FROM events)"""
CU = f"c AS (SELECT {C} + c_custkey AS id, c_name, c_acctbal, c_mktsegment FROM customer)"
PA = f"p AS (SELECT {PT} + p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part)"


def text(name: str, labels: tuple[str, ...], query: str, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """A query in the traversal language."""
    QUERIES[name] = lambda spark, d: shape(load(spark, d, labels or ("in_region",)).query(query).df)
    SQL[name] = sql


def native(name: str, sql: str | None = None, labels: tuple[str, ...] = ("follows",)):
    """A query on the graph by the native operators."""

    def keep(f):
        QUERIES[name] = lambda spark, d: f(load(spark, d, labels))
        if sql:
            SQL[name] = sql
        return f

    return keep


def tables(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FO = ("follows",)
# scans
text("v_all_count", (), "g.V().count()", f"WITH {VS} SELECT count(*) AS value FROM v")
text("v_by_label", (), "g.V().hasLabel('supplier')", f"SELECT {S} + s_suppkey AS id FROM supplier")
text("v_by_id", (), f"g.V({C + 1}, {C + 2}, 5)", f"SELECT {C} + c_custkey AS id FROM customer WHERE c_custkey IN (1, 2)")
text("e_all_count", ("in_region", "in_nation", "placed", "contains"), "g.E().count()", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS value")
text("e_by_label_count", ("in_nation", "placed"), "g.E().hasLabel('placed').count()", "SELECT count(*) AS value FROM orders")
text("e_by_id", FO, "g.E(7000000000003, 7000000000004)", f"WITH {FM} SELECT eid, src, dst, 'follows' AS label FROM fm WHERE eid IN (7000000000003, 7000000000004)")
native("degree", f"WITH {FD} SELECT src AS id, count(*) AS degree FROM f GROUP BY src")(lambda g: g.degrees().where("degree > 0"))
native("neighbors", f"WITH {FD} SELECT dst FROM f WHERE src = {C + 7}")(lambda g: g.neighbors(C + 7))
native("has_edge", f"WITH {FD} SELECT count(*) > 0 AS found FROM f WHERE src = {C} AND dst = {C + 1}")(lambda g: g.has_edge(C, C + 1))
native("contains_vertex", f"WITH {FD} SELECT DISTINCT src AS id FROM f WHERE src < {C + 50}")(lambda g: g.vertices.where(F.col("id") < C + 50).select("id").join(g.adj.select(F.col("src").alias("id")), "id", "left_semi"))
native("id_range_scan", f"WITH {FD} SELECT DISTINCT src AS id FROM f WHERE src BETWEEN {C + 10} AND {C + 90}")(lambda g: g.id_range(C + 10, C + 90))
native("outgoing_edges", f"WITH {FM} SELECT eid, dst FROM fm WHERE src = {C + 3}")(lambda g: g.outgoing(C + 3, "follows").select("eid", "dst"))
native("incoming_edges", f"WITH {FM} SELECT eid, src FROM fm WHERE dst = {C + 3}")(lambda g: g.incoming(C + 3, "follows").select("eid", "src"))
# property lookups
native("find_eq", f"SELECT {C} + c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'", ("in_region",))(lambda g: g.find("c_mktsegment", "BUILDING"))
native("find_range", f"SELECT {PT} + p_partkey AS id FROM part WHERE p_retailprice BETWEEN 950 AND 1000", ("in_region",))(lambda g: g.find_range("p_retailprice", 950.0, 1000.0))
native("property_keys", "SELECT * FROM (VALUES ('r_name', (SELECT count(r_name) FROM region)), ('n_name', (SELECT count(n_name) FROM nation)), ('c_name', (SELECT count(c_name) FROM customer)), ('c_acctbal', (SELECT count(c_acctbal) FROM customer)), ('c_mktsegment', (SELECT count(c_mktsegment) FROM customer)), ('s_name', (SELECT count(s_name) FROM supplier)), ('s_acctbal', (SELECT count(s_acctbal) FROM supplier)), ('p_name', (SELECT count(p_name) FROM part)), ('p_brand', (SELECT count(p_brand) FROM part)), ('p_type', (SELECT count(p_type) FROM part)), ('p_size', (SELECT count(p_size) FROM part)), ('p_retailprice', (SELECT count(p_retailprice) FROM part)), ('o_orderstatus', (SELECT count(o_orderstatus) FROM orders)), ('o_totalprice', (SELECT count(o_totalprice) FROM orders)), ('o_orderdate', (SELECT count(o_orderdate) FROM orders)), ('o_orderpriority', (SELECT count(o_orderpriority) FROM orders))) t(key, n)", ("in_region",))(lambda g: g.property_keys())
native("property_profile", "SELECT 'p_brand' AS key, 'string' AS type, count(p_brand) AS n, count(DISTINCT p_brand) AS n_distinct FROM part", ("in_region",))(lambda g: g.profile("p_brand"))
# logs
LOG = f"log AS (SELECT {C} + o_custkey AS src, o_orderstatus AS dst, CASE WHEN o_orderkey % 5 = 0 THEN 'del' ELSE 'add' END AS op, o_orderkey AS ts, o_totalprice AS value FROM orders)"


def order_log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select((F.lit(C) + F.col("o_custkey")).alias("src"), F.col("o_orderstatus").alias("dst"), F.when(F.col("o_orderkey") % 5 == 0, "del").otherwise("add").alias("op"), F.col("o_orderkey").alias("ts"), F.lit(0).alias("seq"), F.col("o_totalprice").alias("value"))


def current(where: str = "true", columns: str = "src, dst") -> str:
    return f"WITH {LOG} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC) AS n FROM log WHERE {where}) WHERE n = 1"


tables("edge_log_current", current() + " AND op <> 'del'")(lambda s, d: logs.fold(order_log(s, d), ["src", "dst"]))
tables("edge_log_snapshot", current("ts <= 5000") + " AND op <> 'del'")(lambda s, d: logs.fold(order_log(s, d), ["src", "dst"], at=5000))
tables("edge_delete", current(columns="src, dst") + " AND op = 'del'")(lambda s, d: logs.compact(order_log(s, d), ["src", "dst"]).where("op = 'del'").select("src", "dst"))
tables("prop_log_current", current(columns="src, dst, value") + " AND op <> 'del'")(lambda s, d: logs.fold(order_log(s, d), ["src", "dst"], ["value"]))
tables("vertex_versions", f"WITH {LOG} SELECT src, dst, op, ts FROM log WHERE src = {C + 5}")(lambda s, d: logs.versions(order_log(s, d), F.col("src") == C + 5).select("src", "dst", "op", "ts"))
tables("log_compact", current(columns="src, dst, op, ts"))(lambda s, d: logs.compact(order_log(s, d), ["src", "dst"]).select("src", "dst", "op", "ts"))
# hops
text("out_label", ("placed",), f"g.V({C + 1}).out('placed')", f"SELECT DISTINCT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1")
text("in_label", ("in_nation",), "g.V(2000000003).in('in_nation')", f"SELECT {C} + c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {S} + s_suppkey FROM supplier WHERE s_nationkey = 3")
text("both_label", FO, f"g.V({C + 1}).both('follows')", f"WITH {FD} SELECT dst AS id FROM f WHERE src = {C + 1} UNION ALL SELECT src FROM f WHERE dst = {C + 1}")
text("out_multi_label", ("in_nation", "placed"), f"g.V({C + 1}).out('placed', 'in_nation')", f"SELECT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1 UNION ALL SELECT 2000000000 + c_nationkey FROM customer WHERE c_custkey = 1")
text("out_e", FO, f"g.V({C + 1}).outE('follows')", f"WITH {FM} SELECT eid, src, dst, 'follows' AS label FROM fm WHERE src = {C + 1}")
text("in_e", FO, f"g.V({C + 1}).inE('follows')", f"WITH {FM} SELECT eid, src, dst, 'follows' AS label FROM fm WHERE dst = {C + 1}")
text("both_e", FO, f"g.V({C + 1}).bothE('follows')", f"WITH {FM} SELECT eid, src, dst, 'follows' AS label FROM fm WHERE src = {C + 1} UNION ALL SELECT eid, src, dst, 'follows' FROM fm WHERE dst = {C + 1}")
text("e_out_v", FO, "g.E(7000000000003).outV()", f"WITH {FM} SELECT src AS id FROM fm WHERE eid = 7000000000003")
text("e_in_v", FO, "g.E(7000000000003).inV()", f"WITH {FM} SELECT dst AS id FROM fm WHERE eid = 7000000000003")
text("other_v", FO, f"g.V({C + 1}).bothE('follows').otherV()", f"WITH {FM} SELECT dst AS id FROM fm WHERE src = {C + 1} UNION ALL SELECT src FROM fm WHERE dst = {C + 1}")
text("two_hop", FO, f"g.V({C + 1}).out('follows').out('follows')", f"WITH {FD} SELECT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1}")
text("first_slice", ("placed",), "g.V().hasLabel('customer').has('c_mktsegment','BUILDING').out('placed').has('o_totalprice', gt(100000)).count()", "SELECT count(*) AS value FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
# filters
PART = "g.V().hasLabel('part')"
for name, step, sql in (
    ("has_eq", ".has('p_brand', 'Brand#11')", "p_brand = 'Brand#11'"),
    ("has_gt", ".has('p_size', gt(40))", "p_size > 40"),
    ("has_range", ".has('p_size', and(gte(10), lt(20)))", "p_size >= 10 AND p_size < 20"),
    ("has_key", ".has('p_name')", "p_name IS NOT NULL"),
    ("has_value", ".hasValue('Brand#11')", "p_brand = 'Brand#11' OR p_name = 'Brand#11' OR p_type = 'Brand#11'"),
    ("containing", ".has('p_name', containing('e'))", "contains(p_name, 'e')"),
    ("starting_with", ".has('p_brand', startingWith('Brand#2'))", "starts_with(p_brand, 'Brand#2')"),
    ("ending_with", ".has('p_brand', endingWith('3'))", "ends_with(p_brand, '3')"),
    ("matching", ".has('p_brand', matching('#[12]3$'))", "regexp_matches(p_brand, '#[12]3$')"),
    ("and_or_not", ".has('p_size', or(lt(5), and(gt(20), not(gt(25)))))", "p_size < 5 OR (p_size > 20 AND NOT p_size > 25)"),
    ("has_within", ".has('p_size', within(1, 7, 9))", "p_size IN (1, 7, 9)"),
    ("has_without", ".has('p_size', without(1, 7, 9))", "p_size NOT IN (1, 7, 9)"),
    ("has_strict_type", ".has('p_size', 7.0)", "false"),
    ("has_property_pred", ".filter(hasProperty('p_size', lte(3)))", "p_size <= 3"),
):
    text(name, (), PART + step, f"WITH {PA} SELECT id FROM p WHERE {sql}")
text("where_gt", (), PART + ".values('p_size').where(gt(45))", "SELECT p_size AS value FROM part WHERE p_size > 45")
text("where_within_values", (), PART + ".values('p_size').where(within(3, 4))", "SELECT p_size AS value FROM part WHERE p_size IN (3, 4)")
text("has_label_edge", ("in_nation", "placed"), "g.E().hasLabel('in_nation').inV().dedup().count()", "SELECT count(DISTINCT k) AS value FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
text("edge_has", ("contains",), "g.E().hasLabel('contains').has('l_quantity', gt(45.0)).count()", "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 45")
text("dedup", FO, f"g.V({C + 1}).out('follows').out('follows').dedup()", f"WITH {FD} SELECT DISTINCT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1}")
text("where_neq", FO, f"g.V({C + 1}).out('follows').out('follows').where(neq(V({C + 1})))", f"WITH {FD} SELECT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1} AND b.dst <> {C + 1}")
text("where_within", FO, f"g.V({C}).out('follows').where(within(g.V({C + 1}).both('follows').both('follows')))", f"WITH {FD}, b AS (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f) SELECT dst AS id FROM f WHERE src = {C} AND dst IN (SELECT y.dst FROM b x JOIN b y ON x.dst = y.src WHERE x.src = {C + 1})")
text("where_without", FO, f"g.V({C + 1}).out('follows').aggregate('x').out('follows').where(without('x'))", f"WITH {FD} SELECT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1} AND b.dst NOT IN (SELECT dst FROM f WHERE src = {C + 1})")
text("where_traversal", ("placed",), "g.V().hasLabel('customer').where(out('placed').has('o_totalprice', gt(400000))).count()", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE o_totalprice > 400000")
# projection
text("values_one", (), "g.V().hasLabel('nation').values('n_name')", "SELECT n_name AS value FROM nation")
text("values_many", (), "g.V().hasLabel('customer').values('c_name', 'c_mktsegment')", "SELECT c_name AS value FROM customer UNION ALL SELECT c_mktsegment FROM customer")
text("properties_all", (), "g.V().hasLabel('region').properties()", "SELECT r_name AS value FROM region")
text("property_map", (), "g.V().hasLabel('nation').propertyMap('n_name')", "SELECT 2000000000 + n_nationkey AS cur, n_name AS n FROM nation", lambda d: d.select("cur", F.col("props")["n_name"].alias("n")))
text("project_id_props", (), "g.V().hasLabel('supplier').project('id', 's_name', 's_acctbal')", f"SELECT {S} + s_suppkey AS id, s_name, s_acctbal FROM supplier")
text("ids", (), "g.V().hasLabel('region').id()", "SELECT 1000000000 + r_regionkey AS value FROM region")
text("as_select", FO, f"g.V({C + 1}, {C + 2}).as('a').out('follows').as('b').select('a', 'b')", f"WITH {FD} SELECT src AS a, dst AS b FROM f WHERE src IN ({C + 1}, {C + 2})")
text("path_two_hop", FO, f"g.V({C + 1}).out('follows').out('follows').path()", f"WITH {FD} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1}", lambda d: d.select(F.col("value")[0].alias("x"), F.col("value")[1].alias("y"), F.col("value")[2].alias("z")))
# aggregates
for name, sql in (("sum", "coalesce(sum(p_size), 0)"), ("mean", "coalesce(avg(p_size), 0)"), ("max", "max(p_size)"), ("min", "min(p_size)")):
    text(name, (), f"{PART}.values('p_size').{name}()", f"SELECT CAST({sql} AS DOUBLE) AS value FROM part")
    text(f"empty_{name}", (), f"{PART}.has('p_size', gt(9999)).values('p_size').{name}()", f"SELECT CAST({sql} AS DOUBLE) AS value FROM part WHERE p_size > 9999")
text("fold_sorted", (), "g.V().hasLabel('nation').values('n_name').fold()", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation", lambda d: d.select(F.array_join("value", ",").alias("value")))
text("group_count", FO, "g.V().hasLabel('customer').out('follows').groupCount()", f"WITH {FD} SELECT dst AS key, count(*) AS cnt FROM f GROUP BY dst")
text("group_count_by", (), PART + ".groupCount().by('p_brand')", "SELECT p_brand AS key, count(*) AS cnt FROM part GROUP BY p_brand")
text("group_by_collect", (), "g.V().hasLabel('customer').group().by('c_mktsegment')", f"SELECT c_mktsegment AS key, count(*) AS n, min({C} + c_custkey) AS least FROM customer GROUP BY 1", lambda d: d.select("key", F.size("members").cast("long").alias("n"), F.col("members")[0].alias("least")))
text("distinct_count", (), PART + ".values('p_type').dedup().count()", "SELECT count(DISTINCT p_type) AS value FROM part")


@native("engine_aggs", "SELECT count(*) AS count, CAST(sum(p_size) AS DOUBLE) AS sum_p_size, avg(p_size) AS avg_p_size, min(p_brand) AS min_p_brand, max(p_retailprice) AS max_p_retailprice, count(DISTINCT p_type) AS distinct_p_type FROM part", ("in_region",))
def engine_aggs(g) -> DataFrame:
    return g.vertices.where("label = 'part'").agg(F.count("*").alias("count"), F.sum(F.col("p_size").cast("double")).alias("sum_p_size"), F.avg("p_size").alias("avg_p_size"), F.min("p_brand").alias("min_p_brand"), F.max("p_retailprice").alias("max_p_retailprice"), F.countDistinct("p_type").alias("distinct_p_type"))


# order and limits
text("order_natural", (), "g.V().hasLabel('nation').values('n_name').order().limit(7)", "SELECT n_name AS value FROM nation ORDER BY 1 LIMIT 7")
text("order_by_prop_desc", (), PART + ".order().by('p_retailprice', desc).limit(10)", f"SELECT {PT} + p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
INFLUENCERS = "g.V().hasLabel('customer').order().by(inE('follows').count(), desc).limit(10).project('id','followers').by(id()).by(inE('follows').count())"
IN_SQL = f"WITH {FM} SELECT dst AS id, count(*) AS followers FROM fm GROUP BY dst ORDER BY followers DESC, id LIMIT 10"
text("order_by_subtraversal", FO, INFLUENCERS, IN_SQL)
text("limit", (), PART + ".limit(25)", f"SELECT {PT} + p_partkey AS id FROM part ORDER BY 1 LIMIT 25")
text("skip", (), "g.V().hasLabel('supplier').skip(90)", f"SELECT {S} + s_suppkey AS id FROM supplier ORDER BY 1 OFFSET 90")
text("range", (), PART + ".range(5, 15)", f"SELECT {PT} + p_partkey AS id FROM part ORDER BY 1 LIMIT 10 OFFSET 5")
text("order_local_topk", FO, "g.V().hasLabel('customer').out('follows').groupCount().order(local).by(values, desc).limit(5)", f"WITH {FD} SELECT dst AS key, count(*) AS cnt FROM f GROUP BY dst ORDER BY cnt DESC, key LIMIT 5")
# branches
text("union", (), PART + ".union(has('p_size', lt(3)), has('p_size', lt(5)))", f"WITH {PA} SELECT id FROM p WHERE p_size < 3 UNION ALL SELECT id FROM p WHERE p_size < 5")
text("choose", ("in_nation", "placed"), f"g.V({C + 1}, {S + 1}).choose(hasLabel('customer'), out('placed'), out('in_nation'))", f"SELECT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1 UNION ALL SELECT 2000000000 + s_nationkey FROM supplier WHERE s_suppkey = 1")
text("optional", ("placed",), f"g.V({C + 1}, {S + 1}).optional(out('placed'))", f"SELECT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1 UNION ALL SELECT {S + 1}")
text("coalesce", ("in_nation", "placed"), f"g.V({C + 1}, {S + 1}).coalesce(out('placed'), out('in_nation'))", f"SELECT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1 UNION ALL SELECT 2000000000 + s_nationkey FROM supplier WHERE s_suppkey = 1")
text("local_limit", FO, "g.V().hasLabel('customer').local(out('follows').limit(2))", f"WITH {FD} SELECT dst AS id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM f) WHERE n <= 2")
text("side_effect", (), "g.V().hasLabel('region').sideEffect(count())", "SELECT 1000000000 + r_regionkey AS id FROM region")
text("repeat_times", FO, f"g.V({C + 1}).repeat(out('follows').dedup()).times(3)", f"WITH {FD}, a AS (SELECT DISTINCT dst AS id FROM f WHERE src = {C + 1}), b AS (SELECT DISTINCT dst AS id FROM f JOIN a ON src = id) SELECT DISTINCT dst AS id FROM f JOIN b ON src = id")
text("repeat_until", FO, f"g.V({C + 1}).repeat(out('follows').dedup()).until(has('c_mktsegment', 'BUILDING')).times(3)", f"WITH {FD}, {CU}, a AS (SELECT DISTINCT dst AS id FROM f WHERE src = {C + 1}), ar AS (SELECT id FROM a JOIN c USING (id) WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT DISTINCT dst AS id FROM f JOIN ar ON src = id), br AS (SELECT id FROM b JOIN c USING (id) WHERE c_mktsegment <> 'BUILDING'), d AS (SELECT DISTINCT dst AS id FROM f JOIN br ON src = id), u AS (SELECT id FROM a UNION ALL SELECT id FROM b UNION ALL SELECT id FROM d) SELECT id FROM u JOIN c USING (id) WHERE c_mktsegment = 'BUILDING'")
text("repeat_emit", FO, f"g.V({C + 1}).repeat(out('follows').dedup()).times(2).emit()", f"WITH {FD}, a AS (SELECT DISTINCT dst AS id FROM f WHERE src = {C + 1}) SELECT id FROM a UNION ALL (SELECT DISTINCT dst FROM f JOIN a ON src = id)")


# mutations
def mutate(name: str, query: str, after: Callable, sql: str, labels=("in_region",)) -> None:
    QUERIES[name] = lambda spark, d: after(load(spark, d, labels).query(query).graph)
    SQL[name] = sql


mutate("add_v", "g.addV('region')", lambda g: g.vertices.groupBy("label").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("label = 'region'"), f"WITH {VS} SELECT 'region' AS label, count(*) + 1 AS n, (SELECT max(id) + 1 FROM v) AS top FROM region")
mutate("add_e_cross", f"g.V({C + 1}, {C + 2}).addE('knows').to(g.V({C + 3}))", lambda g: g.edges.where("label = 'knows'").select("src", "dst"), f"SELECT * FROM (VALUES ({C + 1}, {C + 3}), ({C + 2}, {C + 3})) t(src, dst)")
mutate("set_property", "g.V().hasLabel('region').property('r_name', 'X')", lambda g: g.vertices.where("label = 'region'").select("id", "r_name"), "SELECT 1000000000 + r_regionkey AS id, 'X' AS r_name FROM region")
native("delete_vertex", f"WITH {FM} SELECT count(*) AS n FROM fm WHERE src >= {C + 20} AND dst >= {C + 20}")(lambda g: g.delete_vertices(g.vertices.where(F.col("id") < C + 20)).edges.agg(F.count("*").alias("n")))
# algorithms
BFS = f"WITH RECURSIVE {FD}, r(id, depth) AS (SELECT {C}, 0 UNION SELECT dst, depth + 1 FROM r JOIN f ON src = id WHERE depth < 10)"
BFS_SQL = BFS + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id"
native("bfs_depth", BFS_SQL)(lambda g: alg.bfs(g.adj, C).select("id", "depth"))
native("bfs_range_order", BFS_SQL.replace("GROUP BY id", "GROUP BY id").replace("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r", f"SELECT id, CAST(min(depth) AS INTEGER) AS depth, id BETWEEN {C + 100} AND {C + 200} AS in_range FROM r"))(lambda g: alg.range_bfs(g.adj, C, C + 100, C + 200))
native("dfs_reachable", BFS_SQL.replace("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r", "SELECT id FROM r"))(lambda g: alg.bfs(g.adj, C).select("id"))
native("shortest_path_length", BFS_SQL.replace("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id", f"SELECT min(depth) + 1 AS n FROM r WHERE id = {C + 99}"))(lambda g: alg.shortest_path(g.adj, C, C + 99).agg(F.count("*").alias("n")))
native("sssp", BFS_SQL.replace("CAST(min(depth) AS INTEGER) AS depth", "CAST(min(depth) AS DOUBLE) AS distance").replace("depth < 10", "depth < 12"))(lambda g: alg.sssp(g.adj, C))
native("khop_walk", f"WITH {FD}, a AS (SELECT DISTINCT dst AS id FROM f WHERE src = {C}), b AS (SELECT DISTINCT dst AS id FROM f JOIN a ON src = id) SELECT 1 AS level, id FROM a UNION ALL SELECT 2, id FROM b")(lambda g: alg.k_hop(g.adj, C, 2))
native("khop_shortest", BFS_SQL.replace("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id", "SELECT CAST(min(depth) AS INTEGER) AS level, id FROM r GROUP BY id HAVING min(depth) BETWEEN 1 AND 2"))(lambda g: alg.k_hop(g.adj, C, 2, shortest=True))
PR = FD + f", ids AS (SELECT {C} + c_custkey AS id FROM customer), n AS (SELECT count(*) AS n FROM ids), deg AS (SELECT src, count(*) AS d FROM f GROUP BY src), p0 AS (SELECT id, 1.0::DOUBLE / n AS s FROM ids, n)"
for _i in range(1, 4):
    PR += f", p{_i} AS (SELECT ids.id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(q.s / d), 0) AS s FROM ids CROSS JOIN n LEFT JOIN f ON f.dst = ids.id LEFT JOIN p{_i - 1} q ON q.id = f.src LEFT JOIN deg ON deg.src = f.src GROUP BY ids.id)"
native("pagerank", f"WITH {PR} SELECT id, CAST(round(s * 1e9) AS BIGINT) AS score FROM p3")(lambda g: alg.pagerank(g.vertices.where("label = 'customer'"), g.adj, rounds=3).select("id", F.round(F.col("score") * 1e9).cast("long").alias("score")))
COMPONENTS_SQL = f"""WITH RECURSIVE {FD}, s AS (SELECT src, dst FROM f UNION SELECT dst, src FROM f),
 r(id, x) AS (SELECT {C} + c_custkey, {C} + c_custkey FROM customer UNION SELECT r.id, dst FROM r JOIN s ON src = x) SELECT id, min(x) AS component FROM r GROUP BY id"""
native("components", COMPONENTS_SQL)(lambda g: alg.components(g.vertices.where("label = 'customer'"), g.adj))
RANGE_SQL = f"WITH {FD} SELECT count(DISTINCT src) AS n_vertices, count(*) FILTER (WHERE dst BETWEEN {C + 100} AND {C + 300}) AS n_edges, n_edges / (n_vertices * (n_vertices - 1))::DOUBLE AS density FROM f WHERE src BETWEEN {C + 100} AND {C + 300}"
native("range_query", RANGE_SQL)(lambda g: alg.range_summary(g.vertices, g.adj, C + 100, C + 300))
native("range_neighbors", f"WITH {FD} SELECT src, dst FROM f WHERE src BETWEEN {C + 100} AND {C + 300} AND dst BETWEEN {C + 100} AND {C + 300}")(lambda g: g.adj.where(F.col("src").between(C + 100, C + 300) & F.col("dst").between(C + 100, C + 300)))
native("multi_range", " UNION ALL ".join(f"SELECT * FROM ({RANGE_SQL.replace('SELECT count(DISTINCT', f'SELECT {i} AS range_no, count(DISTINCT').replace(f'{C + 100}', str(C + a)).replace(f'{C + 300}', str(C + b))})" for i, (a, b) in enumerate(((10, 80), (100, 300)))))(lambda g: alg.multi_range(g.adj, [(C + 100, C + 300), (C + 10, C + 80)]))
native("range_aware_sp", BFS.replace("depth", "w").replace(f"SELECT {C}, 0 UNION", f"SELECT {C}, CAST(0 AS DECIMAL(9, 1)), 0 UNION").replace("r(id, w)", "r(id, w, h)").replace(f"SELECT dst, w + 1 FROM r JOIN f ON src = id WHERE w < 10", f"SELECT dst, CAST(w + CASE WHEN dst BETWEEN {C} AND {C + 400} THEN 0.8 ELSE 1.0 END AS DECIMAL(9, 1)), h + 1 FROM r JOIN f ON src = id WHERE h < 8") + " SELECT id, CAST(min(w) AS DOUBLE) AS weight FROM r GROUP BY id")(lambda g: alg.range_aware_distances(g.adj, C, [(C, C + 400)]))
native("pattern_triangle", f"WITH {FD} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM f a JOIN f b ON a.dst = b.src JOIN f c ON b.dst = c.src AND c.dst = a.src WHERE x <> y AND y <> z AND x <> z")(lambda g: alg.match(g.vertices, g.edges, [("x", "y", "follows"), ("y", "z", "follows"), ("z", "x", "follows")]))
native("pattern_typed", f"WITH {FD}, {CU} SELECT a.src AS x, a.dst AS y FROM f a JOIN f b ON a.dst = b.src AND b.dst = a.src JOIN c ON c.id = a.src WHERE a.src <> a.dst AND c_mktsegment = 'BUILDING'")(lambda g: alg.match(g.vertices, g.edges, [("x", "y", "follows"), ("y", "x", "follows")], {"x": F.col("c_mktsegment") == "BUILDING"}))
native("network_metrics", f"WITH {FM} SELECT v AS n_vertices, e AS n_edges, 2 * e / v::DOUBLE AS avg_degree, e / (v * (v - 1) / 2)::DOUBLE AS density FROM (SELECT count(*) AS v FROM customer), (SELECT count(*) AS e FROM fm)")(lambda g: alg.network_metrics(g.vertices.where("label = 'customer'"), g.edges))
native("degree_filters", f"WITH {FD} SELECT src AS id, count(*) AS degree FROM f GROUP BY src HAVING count(*) BETWEEN 12 AND 14 AND NOT count(*) = 13")(lambda g: g.degrees().where(p.degree_range(12, 14) & ~(F.col("degree") == 13)))
native("engine_query", f"WITH {FD} SELECT concat('v', {C} + c_custkey) AS vertex_id, count(dst) AS degree, any_value(c_name) AS c_name FROM customer LEFT JOIN f ON src = {C} + c_custkey WHERE c_acctbal BETWEEN 0 AND 500 AND c_mktsegment <> 'BUILDING' GROUP BY c_custkey")(lambda g: g.vertices.where("label = 'customer'").where(p.property_range("c_acctbal", 0.0, 500.0) & p.property_not_equals("c_mktsegment", "BUILDING")).join(g.degrees(), "id").select(F.concat(F.lit("v"), "id").alias("vertex_id"), "degree", "c_name"))
native("random_walk")(lambda g: alg.random_walk(g.adj, C))
native("locality", f"WITH {FD}, gaps AS (SELECT src, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM f) SELECT src AS id, exp(-coalesce(avg(gap), 0) / 1e6) AS score FROM gaps GROUP BY src")(lambda g: alg.locality(g.adj))
# cost model
DEG = f"WITH {FD}, d AS (SELECT src AS id, count(*) AS degree FROM f GROUP BY src)"
native("update_cost", f"{DEG} SELECT id, CAST(round((2 * 8 * 10 * 4 / 4096.0 + degree * (0.5 / (0.5 * 9))) * 1e6) AS BIGINT) AS delta, CAST(round((2 + (degree + 1) * 8 / 4096.0 + (degree + 2) * 8 * 10 * 4 / 4096.0) * 1e6) AS BIGINT) AS pivot FROM d")(lambda g: g.degrees().where("degree > 0").select("id", F.round(cost.delta_cost(F.col("degree")) * 1e6).cast("long").alias("delta"), F.round(cost.pivot_cost(F.col("degree")) * 1e6).cast("long").alias("pivot")))
native("update_method", f"{DEG} SELECT id, CASE WHEN degree >= 12 THEN 'delta' ELSE 'pivot' END AS method FROM d")(lambda g: g.degrees().where("degree > 0").select("id", cost.method(F.col("degree"), 12).alias("method")))
tables("workload_class", "SELECT user_id, CASE WHEN s > 0.7 THEN 'ReadHeavy' WHEN s < 0.3 THEN 'WriteHeavy' ELSE 'Balanced' END AS class FROM (SELECT user_id, count(*) FILTER (WHERE value > 40) / count(*)::DOUBLE AS s FROM events GROUP BY user_id)")(lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 40).alias("l"), F.count("*").alias("n")).select("user_id", cost.workload(F.col("l"), F.col("n")).alias("class")))
tables("morris_estimate", "SELECT p_partkey, (pow(2, p_size % 8) - 1) * 16 + pow(2, p_size % 8) * (p_partkey % 16) AS estimate FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", cost.morris_estimate(F.col("p_size") % 8, F.col("p_partkey") % 16).alias("estimate")))
tables("histogram_buckets", "SELECT b AS bound, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in cost.BOUNDS) + " ELSE 5000.0 END::DOUBLE AS b FROM events) GROUP BY b")(lambda s, d: read(s, d, "events").groupBy(cost.bucket(F.col("value")).alias("bound")).agg(F.count("*").alias("n")))


# sample applications
def mutual(g, a: int, b: int) -> DataFrame:
    return g.neighbors(a).join(g.neighbors(b), "dst", "left_semi").withColumnRenamed("dst", "id")


MUTUAL = f"WITH {FD} SELECT dst AS id FROM f WHERE src = {C + 154} AND dst IN (SELECT dst FROM f WHERE src = {C + 1094})"
native("mutual_friends", MUTUAL)(lambda g: mutual(g, C + 154, C + 1094))
native("mutual_count", MUTUAL.replace("SELECT dst AS id FROM f WHERE src =", "SELECT count(*) AS n FROM f WHERE src ="))(lambda g: mutual(g, C + 154, C + 1094).agg(F.count("*").alias("n")))
text("friends_of_friends", FO, f"g.V({C + 1}).out('follows').out('follows').where(neq(V({C + 1}))).dedup()", f"WITH {FD} SELECT DISTINCT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1} AND b.dst <> {C + 1}")
text("influencers", FO, INFLUENCERS, IN_SQL)
tables("local_connections", "SELECT b.c_custkey AS id FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey = 7 AND b.c_custkey <> 7")(lambda s, d: read(s, d, "customer").join(read(s, d, "customer").where("c_custkey = 7").select("c_nationkey"), "c_nationkey", "left_semi").where("c_custkey <> 7").select(F.col("c_custkey").alias("id")))
BOUGHT = "b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def collab(g, who: int) -> DataFrame:
    b = g.pairs("purchased")
    mine = b.where(F.col("src") == who).select("dst")
    others = b.join(mine, "dst", "left_semi").where(F.col("src") != who).groupBy("src").agg(F.count("*").alias("w"))
    return b.join(others, "src").join(mine, "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "id").limit(10)


native("collab_filter", f"WITH {BOUGHT} SELECT {PT} + z.p AS id, CAST(count(*) AS BIGINT) AS score FROM b x JOIN b y ON x.p = y.p AND y.c <> 1 JOIN b z ON z.c = y.c WHERE x.c = 1 AND z.p NOT IN (SELECT p FROM b WHERE c = 1) GROUP BY z.p ORDER BY score DESC, id LIMIT 10", ("purchased",))(lambda g: collab(g, C + 1))
native("popular_unseen", f"WITH {BOUGHT} SELECT {PT} + p AS id, count(*) AS n FROM b WHERE p NOT IN (SELECT p FROM b WHERE c = 1) GROUP BY p ORDER BY n DESC, id LIMIT 10", ("purchased",))(lambda g: g.pairs("purchased").join(g.pairs("purchased").where(F.col("src") == C + 1).select("dst"), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(10))
text("product_search", (), PART + ".has('p_type', containing('ECON')).has('p_retailprice', and(gte(900.0), lte(1200.0))).has('p_size', gte(20))", f"WITH {PA} SELECT id FROM p WHERE contains(p_type, 'ECON') AND p_retailprice BETWEEN 900 AND 1200 AND p_size >= 20")
tables("sales_by_category", "SELECT p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sales, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")(lambda s, d: read(s, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("e"), F.sum(F.col("l_quantity").cast("long")).alias("q")).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(F.sum("e").cast("double").alias("sales"), F.sum("q").alias("quantity")))
text("top_customers", (), "g.V().hasLabel('customer').order().by('c_acctbal', desc).limit(10)", f"SELECT {C} + c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")


def timeline_of(g) -> DataFrame:
    near = g.pairs("follows").where(F.col("src") == C + 1).select(F.col("dst").alias("src")).orderBy("src").limit(50)
    placed = g.edges.where("label = 'placed'").select("src", F.col("dst").alias("id")).join(near, "src")
    posts = g.vertices.where("label = 'order'").select("id", "o_orderdate").join(placed, "id")
    return posts.orderBy(F.desc("o_orderdate"), "id").limit(20).select("id", F.col("src").alias("author"), "o_orderdate")


native("timeline", f"WITH {FD}, n AS (SELECT dst FROM f WHERE src = {C + 1} ORDER BY dst LIMIT 50) SELECT {O} + o_orderkey AS id, dst AS author, o_orderdate FROM n JOIN orders ON {C} + o_custkey = dst ORDER BY o_orderdate DESC, id LIMIT 20", ("placed", "follows"))(timeline_of)
text("user_posts", ("placed",), f"g.V({C + 1}).out('placed').order().by('o_orderdate', desc).limit(10)", f"SELECT {O} + o_orderkey AS id FROM orders WHERE o_custkey = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def comments(s: SparkSession, d: str) -> DataFrame:
    clicks = read(s, d, "events").where("event_type = 'click'").join(read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    return clicks.orderBy("ts", "event_id").select("event_id", "event_type", F.col("c_name").alias("author"))


tables("post_comments", "SELECT event_id, event_type, c_name AS author FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click' ORDER BY ts, event_id")(comments)


@native("follow_recs", f"WITH {FD}, n AS (SELECT dst FROM f WHERE src = {C + 1} ORDER BY dst LIMIT 10) SELECT f.dst AS id, count(*) AS n FROM n JOIN f ON f.src = n.dst WHERE f.dst <> {C + 1} AND f.dst NOT IN (SELECT dst FROM f WHERE src = {C + 1}) GROUP BY f.dst ORDER BY n DESC, id LIMIT 10")
def follow_recs(g) -> DataFrame:
    near = g.neighbors(C + 1).orderBy("dst").limit(10).withColumnRenamed("dst", "src")
    two = g.adj.join(near, "src").where(F.col("dst") != C + 1).join(g.neighbors(C + 1), "dst", "left_anti")
    return two.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(10)


text("user_search", (), "g.V().hasLabel('customer').has('c_name', containing('12')).limit(10)", f"SELECT {C} + c_custkey AS id FROM customer WHERE contains(c_name, '12') ORDER BY 1 LIMIT 10")
native("profile_bundle", f"WITH {FM} SELECT {C + 1} AS id, (SELECT count(*) FROM fm WHERE src = {C + 1}) AS following, (SELECT count(*) FROM fm WHERE dst = {C + 1}) AS followers, (SELECT c_name FROM customer WHERE c_custkey = 1) AS c_name")(lambda g: g.vertices.where(F.col("id") == C + 1).join(g.edges.agg(F.count_if(F.col("src") == C + 1).alias("following"), F.count_if(F.col("dst") == C + 1).alias("followers")), F.lit(True)).select("id", "following", "followers", "c_name"))
native("counters", f"WITH {FM} SELECT id, sum(o)::BIGINT AS following, sum(i)::BIGINT AS followers FROM (SELECT src AS id, 1 AS o, 0 AS i FROM fm UNION ALL SELECT dst, 0, 1 FROM fm) GROUP BY id")(lambda g: g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("following"), F.sum("e.i").alias("followers")))


from meshwright import catalogue_engine  # noqa: E402, F401  adds its queries to the same tables

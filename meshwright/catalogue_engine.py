"""Queries of the engine interface, of paths, sinks, merges and the cost model, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.catalogue import CU, FD, FM, PA, PT, C, O, native, tables
from meshwright.functions import predicates as p
from meshwright.operators import algorithms as alg
from meshwright.operators import apps
from meshwright.operators import costmodel as cost
from meshwright.operators import engine, merge
from meshwright.sources import sinks
from meshwright.sources.tables import read

DEPTH = f"RECURSIVE {FD}, r(id, depth) AS (SELECT {C}, 0 UNION SELECT dst, depth + 1 FROM r JOIN f ON src = id WHERE depth < 12), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"
FOLLOWS, NONE = ("follows",), ("in_region",)

# engine: filters, projections, aggregates
DEGREES = f"d AS (SELECT c.*, (SELECT count(*) FROM f WHERE src = c.id) AS degree FROM c)"
native("engine_greater_less", f"WITH {CU} SELECT concat('v', id) AS vertex_id FROM c WHERE c_acctbal > 5000 AND c_acctbal < 6000", NONE)(
    lambda g: engine.execute(g, p.property_greater("c_acctbal", 5000.0) & p.property_less("c_acctbal", 6000.0))
)
native("engine_id_in", f"WITH {CU} SELECT concat('v', id) AS vertex_id FROM c WHERE id IN ({C + 3}, {C + 5})", NONE)(lambda g: engine.execute(g, p.vertex_in([C + 3, C + 5, 17])))
native("engine_equals_exists", f"WITH {CU} SELECT concat('v', id) AS vertex_id, c_name FROM c WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL", NONE)(
    lambda g: engine.execute(g, p.property_equals("c_mktsegment", "BUILDING") & p.property_exists("c_acctbal"), ["vertex_id", "c_name"])
)
native("engine_degrees", f"WITH {FD}, {CU}, {DEGREES} SELECT concat('v', id) AS vertex_id, degree, c_name FROM d WHERE degree > 8 AND degree < 12", FOLLOWS)(
    lambda g: engine.execute(g, (F.col("label") == "customer") & p.degree_greater(8) & p.degree_less(12), ["vertex_id", "degree", "c_name"], degrees=True)
)
native("engine_not_or", f"WITH {CU} SELECT count(*) AS count FROM c WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal BETWEEN 0 AND 100)", NONE)(
    lambda g: engine.execute(g, (F.col("label") == "customer") & ~(p.property_equals("c_mktsegment", "BUILDING") | p.property_range("c_acctbal", 0.0, 100.0)), aggregates=[("count",)])
)
native(
    "engine_aggregates",
    f"WITH {PA} SELECT count(*) AS count, CAST(sum(p_size) AS DOUBLE) AS sum_p_size, avg(p_size) AS avg_p_size, 0.0::DOUBLE AS sum_p_name, min(p_brand) AS min_p_brand, max(p_size)::BIGINT AS max_p_size, count(DISTINCT p_type) AS distinct_p_type, 0.0::DOUBLE AS avg_absent FROM p WHERE p_size >= 10",
    NONE,
)(lambda g: engine.execute(g, p.property_range("p_size", 10), aggregates=[("count",), ("sum", "p_size"), ("avg", "p_size"), ("sum", "p_name"), ("min", "p_brand"), ("max", "p_size"), ("distinct", "p_type"), ("avg", "absent")]))
native("engine_aggregates_empty", "SELECT 0::BIGINT AS count, 0.0::DOUBLE AS sum_p_size, 0.0::DOUBLE AS avg_p_size, CAST(NULL AS BIGINT) AS min_p_size, 0::BIGINT AS distinct_p_size", NONE)(
    lambda g: engine.execute(g, p.property_greater("p_size", 10**6), aggregates=[("count",), ("sum", "p_size"), ("avg", "p_size"), ("min", "p_size"), ("distinct", "p_size")])
)
native("prop_delete", f"WITH {CU} SELECT count(*) AS n, count(CASE WHEN id >= {C + 20} THEN c_acctbal END) AS with_balance, count(c_name) AS with_name FROM c", NONE)(
    lambda g: g.delete_properties(g.vertices.where(F.col("id") < C + 20), "c_acctbal", "absent").vertices.where("label = 'customer'").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"), F.count("c_name").alias("with_name"))
)
native("edge_property", f"WITH {FM} SELECT src, dst, CASE WHEN src = {C + 1} THEN 'close' END AS kind FROM fm WHERE src <= {C + 5}", FOLLOWS)(
    lambda g: g.query(f"g.V({C + 1}).outE('follows').property('kind', 'close')").graph.edges.where(F.col("src") <= C + 5).select("src", "dst", "kind")
)

# paths
PATH = f"WITH {DEPTH}, p(pos, id) AS (SELECT depth, id FROM d WHERE id = {C + 99} UNION ALL SELECT p.pos - 1, (SELECT min(f.src) FROM f JOIN d ON d.id = f.src WHERE f.dst = p.id AND d.depth = p.pos - 1) FROM p WHERE p.pos > 0)"
native("shortest_path", f"{PATH} SELECT CAST(pos AS INTEGER) AS pos, id FROM p", FOLLOWS)(lambda g: alg.shortest_path(g.adj, C, C + 99))
native("bounded_path", f"{PATH} SELECT CAST(pos AS INTEGER) AS pos, id FROM p WHERE (SELECT depth FROM d WHERE id = {C + 99}) <= 4", FOLLOWS)(lambda g: alg.shortest_path(g.adj, C, C + 99, max_depth=4))
native("dfs_preorder", None, FOLLOWS)(lambda g: alg.dfs(g.adj, C))
native("range_aware_path", None, FOLLOWS)(lambda g: alg.range_aware_path(g.adj, C, C + 99, [(C, C + 400)]))

# sinks
native("sink_strings", "SELECT concat('v[', 1000000000 + r_regionkey, ']') AS text FROM region", NONE)(lambda g: sinks.strings(g.query("g.V().hasLabel('region')")))
native("sink_string_values", "SELECT r_name AS text FROM region", NONE)(lambda g: sinks.strings(g.query("g.V().hasLabel('region').values('r_name')")))
native("sink_string_path", "SELECT concat('[v[', 2000000000 + n_nationkey, '], v[', 1000000000 + n_regionkey, ']]') AS text FROM nation", NONE)(lambda g: sinks.strings(g.query("g.V().hasLabel('nation').out('in_region').path()"), paths=True))
native("sink_json", """SELECT concat('{"id":', 1000000000 + r_regionkey, ',"type":"vertex"}') AS json FROM region""", NONE)(lambda g: sinks.json(g.query("g.V().hasLabel('region')")))
native("sink_json_path", """SELECT concat('{"elements":[{"id":', 2000000000 + n_nationkey, ',"type":"vertex"},{"id":', 1000000000 + n_regionkey, ',"type":"vertex"}],"type":"path"}') AS json FROM nation""", NONE)(lambda g: sinks.json(g.query("g.V().hasLabel('nation').out('in_region').path()"), paths=True))
native("sink_json_values", """SELECT concat('"', r_name, '"') AS json FROM region""", NONE)(lambda g: sinks.json(g.query("g.V().hasLabel('region').values('r_name')")))
native("sink_json_count", """SELECT concat('{"type":"count","value":', count(*), '}') AS json FROM region""", NONE)(lambda g: sinks.json(g.query("g.V().hasLabel('region').count()"), count=True))
tables("sink_prometheus", "SELECT concat('n_events ', count(*)) AS line FROM events")(lambda s, d: sinks.report(read(s, d, "events").agg(F.count("*").alias("n_events")), "prometheus"))


# merges of range partitions
def ranges(g) -> list[DataFrame]:
    return [g.id_range(C + a, C + b) for a, b in ((10, 40), (30, 60))]


for _name, _how, _sql in (
    ("merge_ordered", lambda parts: merge.ordered(parts, "id"), f"SELECT DISTINCT src AS id FROM f WHERE src BETWEEN {C + 10} AND {C + 60}"),
    ("merge_union", merge.union, f"SELECT DISTINCT src AS id FROM f WHERE src BETWEEN {C + 10} AND {C + 60}"),
    ("merge_unordered", merge.unordered, f"SELECT DISTINCT src AS id FROM f WHERE src BETWEEN {C + 10} AND {C + 40} UNION ALL SELECT DISTINCT src FROM f WHERE src BETWEEN {C + 30} AND {C + 60}"),
    ("merge_intersection", merge.intersection, f"SELECT DISTINCT src AS id FROM f WHERE src BETWEEN {C + 30} AND {C + 40}"),
):
    native(_name, f"WITH {FD} {_sql}", FOLLOWS)(lambda g, how=_how: how(ranges(g)))

# cost model
native("optimal_ratio", f"WITH {FD}, a AS (SELECT avg(n) AS d FROM (SELECT count(*) AS n FROM f GROUP BY src)) SELECT CAST(round(9 * ((d + 2) * 40 + 8192) / (d * 4096) * 1e6) AS BIGINT) AS ratio FROM a", FOLLOWS)(
    lambda g: g.degrees().where("degree > 0").agg(F.avg("degree").alias("d")).select(F.round(cost.optimal_ratio(F.col("d")) * 1e6).cast("long").alias("ratio"))
)
tables("degree_threshold", "SELECT l, u, d, CASE WHEN u = 0 THEN 0 ELSE CAST(floor(greatest(l * d * 4096 / (u * 9 * 41) - 8192 / 41.0 - 1 / 41.0, 0)) AS BIGINT) END AS threshold FROM (SELECT l / 10.0::DOUBLE AS l, 1 - l / 10.0::DOUBLE AS u, (r_regionkey * 10)::DOUBLE AS d FROM region, range(0, 11) t(l))")(
    lambda s, d: read(s, d, "region").select((F.col("r_regionkey") * 10).cast("double").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select((F.col("i") / 10).alias("l"), (1 - F.col("i") / 10).alias("u"), "d").withColumn("threshold", cost.degree_threshold(F.col("l"), F.col("u"), F.col("d")))
)
TREND = "SELECT user_id, a, b, CASE WHEN abs(b - a) < 0.05 THEN 'Stable' WHEN abs(b - a) > 0.3 THEN 'Volatile' WHEN b > a THEN 'IncreasingReads' ELSE 'IncreasingWrites' END AS trend FROM (SELECT user_id, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_id % 2 = 0) AS b FROM events GROUP BY user_id) WHERE b IS NOT NULL"
tables("workload_trend", TREND)(
    lambda s, d: read(s, d, "events").withColumn("read", F.when(F.col("value") > 40, 1.0).otherwise(0.0)).groupBy("user_id").agg(F.avg("read").alias("a"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("read"))).alias("b")).where("b IS NOT NULL").withColumn("trend", cost.trend(F.col("a"), F.col("b")))
)
_slot = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(cost.BOUNDS)) + f" ELSE {len(cost.BOUNDS)} END"
_bound = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in cost.BOUNDS) + f" ELSE {cost.ABOVE}::DOUBLE END"
tables("histogram_percentile", f"WITH b AS (SELECT {_slot} AS slot, {_bound} AS bound, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY slot) AS upto, sum(n) OVER () AS total FROM b) SELECT share::DOUBLE AS share, min(bound) FILTER (WHERE upto >= floor(share / 100 * total)) AS latency FROM c, (VALUES (50.0), (95.0), (99.0)) t(share) GROUP BY share")(
    lambda s, d: cost.percentiles(read(s, d, "events"), "value", [50.0, 95.0, 99.0])
)
tables("morris_error", "SELECT p_partkey, 1.04 / sqrt(pow(2, p_size % 8)) AS error FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", cost.morris_error(F.col("p_size") % 8).alias("error")))

# language: steps that no other query has
native("neq_value", f"WITH {CU} SELECT id FROM c WHERE c_mktsegment <> 'BUILDING'", NONE)(lambda g: g.query("g.V().hasLabel('customer').has('c_mktsegment', neq('BUILDING'))").df)
native("within_step", f"SELECT {PT} + p_partkey AS id FROM part WHERE p_partkey IN (1, 3)", NONE)(lambda g: g.query(f"g.V().hasLabel('part').within(V({PT + 1}, {PT + 3}))").df)
native("add_e_from", f"SELECT * FROM (VALUES ({C + 3}, {C + 1}), ({C + 3}, {C + 2})) t(src, dst)", NONE)(lambda g: g.query(f"g.V({C + 1}, {C + 2}).addE('knows').from(g.V({C + 3}))").graph.edges.where("label = 'knows'").select("src", "dst"))
native("store", f"WITH {FD} SELECT b.dst AS id FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1} AND b.dst NOT IN (SELECT dst FROM f WHERE src = {C + 1})", FOLLOWS)(
    lambda g: g.query(f"g.V({C + 1}).out('follows').store('x').out('follows').where(without('x'))").df
)
native("order_local_group", f"WITH {CU} SELECT c_mktsegment AS key, count(*) AS n FROM c GROUP BY c_mktsegment", NONE)(lambda g: g.query("g.V().hasLabel('customer').group().by('c_mktsegment').order(local).by(values, desc)").df.select("key", F.size("members").cast("long").alias("n")))
native("fluent", f"WITH {FD} SELECT count(*) AS value FROM f a JOIN f b ON a.dst = b.src WHERE a.src = {C + 1}", FOLLOWS)(lambda g: g.g.V(C + 1).out("follows").out("follows").count().df)
native("has_key_step", "SELECT count(*) AS value FROM part WHERE p_brand IS NOT NULL", NONE)(lambda g: g.query("g.V().hasKey('p_brand').count()").df)

# edges and properties by id
E7 = 7_000_000_000_000


def with_registered(g):
    fresh = g.edges.where(F.col("eid").between(E7, E7 + 40)).select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("replied").alias("label"))
    new = g.spark.range(1).select(F.lit(E7 - 1).alias("eid"), F.lit(C + 1).alias("src"), F.lit(C + 2).alias("dst"), F.lit("replied").alias("label"))
    return g.register_edges(fresh.unionByName(new))


native(
    "register_edge",
    f"WITH {FM} SELECT eid, CASE WHEN eid <= {E7 + 40} THEN dst ELSE src END AS src, CASE WHEN eid <= {E7 + 40} THEN src ELSE dst END AS dst, CASE WHEN eid <= {E7 + 40} THEN 'replied' ELSE 'follows' END AS label FROM fm UNION ALL SELECT {E7 - 1}, {C + 1}, {C + 2}, 'replied'",
    FOLLOWS,
)(lambda g: with_registered(g).edges)
native("edge_properties", f"WITH {FM} SELECT eid, 'close' AS kind, NULL::VARCHAR AS absent FROM fm WHERE eid = (SELECT min(eid) FROM fm WHERE eid >= {E7})", FOLLOWS)(
    lambda g: g.set_edge_property(g.edges, "kind", "close").edge_properties(E7, "kind", "absent")
)
native("set_properties", f"WITH {CU} SELECT id, CASE WHEN id < {C + 20} THEN 'X' ELSE c_name END AS c_name, c_mktsegment, CASE WHEN id < {C + 20} THEN 7 END AS rank FROM c", NONE)(
    lambda g: g.set_properties(g.vertices.where(F.col("id") < C + 20), {"c_name": "X", "rank": 7}).vertices.where("label = 'customer'").select("id", "c_name", "c_mktsegment", "rank")
)
native("property_samples", f"WITH {PA} SELECT id, p_brand AS value FROM p WHERE p_brand IS NOT NULL ORDER BY id LIMIT 10", NONE)(lambda g: g.samples("p_brand"))
_held = f"{FD}, n AS (SELECT src % 97 AS cell, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT *, CAST(floor(log2(n / 16.0 + 1)) AS BIGINT) AS exponent FROM n), h AS (SELECT cell, exponent, CAST(floor((n - (pow(2, exponent) - 1) * 16) / pow(2, exponent)) AS BIGINT) AS mantissa FROM e)"
_est = "((pow(2, exponent) - 1) * 16 + pow(2, exponent) * mantissa)"
native("degree_sketch", f"WITH {_held} SELECT * FROM h", FOLLOWS)(lambda g: cost.sketch(g.degrees(), 97))
native("degree_sketch_statistics", f"WITH {_held} SELECT count(*) AS active, sum({_est}) AS total, max({_est}) AS highest, min({_est}) AS lowest, avg({_est}) AS mean, (sum(1.04 / sqrt(pow(2, exponent))) + (97 - count(*)) * 1.04) / count(*) AS mean_error FROM h", FOLLOWS)(
    lambda g: cost.sketch_statistics(cost.sketch(g.degrees(), 97), 97)
)

# social application


def with_likes(g):
    likes = g.vertices.where((F.col("label") == "order") & (F.col("id") % 3 == 0)).select((F.col("id") + 10**15).alias("eid"), F.lit(C + 1).alias("src"), F.col("id").alias("dst"), F.lit("liked").alias("label"))
    return g.add_edges(likes)


native(
    "timeline_liked",
    f"WITH {FD}, n AS (SELECT dst FROM f WHERE src = {C + 1} ORDER BY dst LIMIT 50) SELECT {O} + o_orderkey AS id, dst AS author, o_orderdate, ({O} + o_orderkey) % 3 = 0 AS user_liked FROM n JOIN orders ON {C} + o_custkey = dst ORDER BY o_orderdate DESC, id LIMIT 20",
    ("placed", "follows"),
)(lambda g: apps.timeline(with_likes(g), C + 1, "follows", "placed", "liked", "o_orderdate"))
for _name, _user, _viewer in (("profile", "(SELECT min(dst) FROM f WHERE src = 3000000001)", C + 1), ("profile_of_stranger", str(C + 2), C + 1)):
    native(
        _name,
        f"WITH {FD}, u AS (SELECT {_user} AS id) SELECT u.id, c_name, c_mktsegment, EXISTS (SELECT 1 FROM f WHERE src = {_viewer} AND dst = u.id) AS following, EXISTS (SELECT 1 FROM f WHERE src = u.id AND dst = {_viewer}) AS followed_by, {O} + o_orderkey AS post, o_orderdate "
        f"FROM u JOIN customer ON {C} + c_custkey = u.id LEFT JOIN (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey) ON o_custkey = c_custkey ORDER BY o_orderdate DESC, post LIMIT 20",
        ("placed", "follows"),
    )(
        lambda g, stranger=_name != "profile", viewer=_viewer: apps.profile(
            g, C + 2 if stranger else g.pairs("follows").where(F.col("src") == viewer).agg(F.min("dst")).first()[0], viewer, "follows", "placed", "o_orderdate", ["c_name", "c_mktsegment"]
        )
    )
native("user_search_any", f"WITH {CU} SELECT id FROM c WHERE contains(c_name, '12') OR contains(c_mktsegment, '12') ORDER BY id LIMIT 10", NONE)(lambda g: apps.search(g, "customer", "12", ["c_name", "c_mktsegment"]))
tables("counters_clamped", "SELECT user_id, (sum(d) - least(min(s), 0))::BIGINT AS n FROM (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS d FROM events)) GROUP BY user_id")(
    lambda s, d: apps.clamped(read(s, d, "events").withColumn("d", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)), "user_id", "event_id", "d", block=1024)
)

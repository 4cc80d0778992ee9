"""Small graphs with known answers: chains, stars, loops, and the parts of the library that no query of the catalogue holds."""

import pytest
from pyspark.sql import functions as F

from meshwright.graph import PropertyGraph
from meshwright.operators import algorithms as alg
from meshwright.operators import costmodel as cost
from meshwright.operators import engine
from meshwright.plans.parser import QueryError


@pytest.fixture(scope="module")
def graph(spark):
    def make(edges, props=(), columns=""):
        ids = sorted({x for e in edges for x in e[:2]} | {r[0] for r in props})
        vertices = spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("label", F.lit("node"))
        if props:
            vertices = vertices.join(spark.createDataFrame(props, f"id bigint, {columns}"), "id", "left")
        rows = [(i, e[0], e[1], e[2] if len(e) > 2 else "next") for i, e in enumerate(edges)]
        return PropertyGraph(vertices, spark.createDataFrame(rows, "eid bigint, src bigint, dst bigint, label string"))

    return make


def chain(*ids):
    return list(zip(ids, ids[1:]))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def path(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_chain(graph):
    g = graph(chain(1, 2, 3, 4))
    assert g.query("g.V().count()").df.first()[0] == 4 and len(g.query("g.V().limit(2)").df.collect()) == 2
    assert ids(g.query("g.V(1).out()").df) == [2] and ids(g.query("g.V(1).out().out()").df) == [3]


def test_labels_and_edges(graph):
    g = graph([(1, 2, "friend"), (2, 3, "colleague"), (1, 4, "family")])
    assert len(g.query("g.V(1).outE()").df.collect()) == 2 and ids(g.query("g.V(1).outE().inV()").df) == [2, 4]
    assert len(g.query("g.V(2).inE()").df.collect()) == 1 and len(g.query("g.V(2).bothE()").df.collect()) == 2


def test_paths_and_steps(graph):
    g = graph(chain(1, 2, 3, 4, 5), [(i, i) for i in range(1, 6)], "step bigint")
    assert [list(r[0]) for r in g.query("g.V(1).out().out().path()").df.collect()] == [[1, 2, 3]]
    assert sorted(r[0] for r in g.query("g.V().out().dedup().values('step').where(gt(2))").df.collect()) == [3, 4, 5]


def test_groups(graph):
    g = graph(chain(*range(1, 11)), [(i, "a" if i <= 5 else "b", 10 * i) for i in range(1, 11)], "category string, value bigint")
    assert {r["key"]: r["cnt"] for r in g.query("g.V().groupCount().by('category')").df.collect()} == {"a": 5, "b": 5}
    grouped = g.query("g.V().group().by('category').order(local).by(values, desc)").df.collect()
    assert [len(r["members"]) for r in grouped] == [5, 5]
    assert len(g.query("g.V().union(has('category', 'a'), has('category', 'b'))").df.collect()) == 10


def test_ranges(graph):
    g = graph(chain(*range(1, 11)))
    r = alg.range_summary(g.vertices, g.adj, 3, 7).first()
    assert (r["n_vertices"], r["n_edges"], r["density"]) == (5, 4, 0.2)


def test_components_in_both_directions(graph):
    for edges in (chain(1, 2, 3) + chain(10, 11, 12), chain(3, 2, 1) + chain(12, 11, 10), [(2, 1), (2, 3), (11, 10), (12, 11)]):
        g = graph(edges)
        got = {r["id"]: r["component"] for r in alg.components(g.vertices, g.adj).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}
        assert len(alg.multi_range(g.adj, [(1, 3), (10, 12)]).collect()) == 2


def test_light_paths(graph):
    g = graph(chain(1, 2, 3, 4, 5) + [(5, 1)])
    rows = alg.range_aware_path(g.adj, 1, 5, [(2, 4)]).orderBy("pos").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5] and rows[-1]["weight"] == pytest.approx(3.4)
    assert path(alg.range_aware_path(g.adj, 1, 1, [(2, 4)])) == [1] and path(alg.range_aware_path(g.adj, 1, 9, [(2, 4)])) == []


def test_shortest_paths(graph):
    g = graph(chain(*range(1, 26)) + [(1, 5), (1, 4), (4, 6), (5, 6)])
    assert path(alg.shortest_path(g.adj, 1, 6)) == [1, 4, 6]  # ties by the smallest parent
    assert path(alg.shortest_path(g.adj, 1, 1)) == [1] and path(alg.shortest_path(g.adj, 2, 1)) == []
    assert path(alg.shortest_path(g.adj, 1, 9, max_depth=4)) == [] and len(path(alg.shortest_path(g.adj, 1, 9))) == 6
    assert len(path(alg.shortest_path(g.adj, 8, 25))) == 18


def test_depth_first(graph):
    g = graph([(1, 2), (1, 3), (2, 4), (4, 3), (3, 5)])
    assert path(alg.dfs(g.adj, 1)) == [1, 2, 4, 3, 5]
    assert [(r["id"], r["depth"]) for r in alg.dfs(g.adj, 1, max_depth=3).orderBy("pos").collect()] == [(1, 0), (2, 1), (4, 2), (3, 3)]
    with pytest.raises(ValueError):
        alg.dfs(g.adj, 1, most=3)


def test_depth_first_beyond_a_million_edges(spark):
    n = 1_050
    adj = spark.range(n * n).selectExpr("id div 1050 AS src", "id % 1050 AS dst")  # all pairs: a chain of 10 hops, whose last vertex but one leads to all the rest
    got = alg.dfs(adj, 0).orderBy("pos")
    assert got.dtypes == [("pos", "int"), ("id", "bigint"), ("depth", "int")]
    assert [tuple(r) for r in got.collect()] == [(i, i, min(i, 10)) for i in range(n)]


def test_depth_first_in_order(spark):
    from random import Random

    rng = Random(7)
    for n, m, depth in ((40, 70, 10), (40, 160, 3), (300, 500, 25), (300, 900, 10), (5, 20, 0), (30, 90, 1)):
        edges = {(10 * rng.randrange(n), 10 * rng.randrange(n)) for _ in range(m)} | {(0, 10)}
        want, seen, todo = [], set(), [(0, 0)]
        while todo:
            v, at = todo.pop()
            if v not in seen and at <= depth:
                seen.add(v)
                want.append((len(want), v, at))
                todo += [(t, at + 1) for s, t in sorted(edges, reverse=True) if s == v]
        rows = list(edges)
        rng.shuffle(rows)
        adj = spark.createDataFrame([*rows, (0, None), (None, 10)], "src bigint, dst bigint")
        assert [tuple(r) for r in alg.dfs(adj, 0, max_depth=depth).orderBy("pos").collect()] == want


def test_depth_first_in_blocks():
    import pyarrow as pa

    kind = pa.schema([("src", "int64"), ("dst", "int64")])
    runs = [(5, None), (7, None), (7, 5), (7, 9), (7, 11), (9, None), (9, 7), (9, 20), (20, None), (11, None), (11, 9)]
    for size in (1, 2, 3, 99):
        frames = [pa.record_batch([[r[i] for r in runs[a : a + size]] for i in (0, 1)], schema=kind) for a in range(0, len(runs), size)]
        for block in (1, 2, 64):
            out = [tuple(r.values()) for b in alg.preorder(7, 4, block)(iter(frames)) for r in b.to_pylist()]
            assert out == [(0, 7, 0), (1, 5, 1), (2, 9, 1), (3, 20, 2), (4, 11, 1)]


def test_degrees_stars_loops(graph):
    g = graph([(2, 3), (2, 4), (2, 5)])
    assert [r["vertex_id"] for r in engine.execute(g, F.col("degree") > 1, degrees=True).collect()] == ["v2"]
    star = graph([(1, i) for i in range(2, 102)])
    assert star.degrees().where("id = 1").first()["degree"] == 100
    assert ids(graph([(123, 123)]).neighbors(123), "dst") == [123]


def test_numbers(graph):
    g = graph([], [(i, i, "low" if i <= 5 else "high") for i in range(1, 11)], "value bigint, category string")
    small = "g.V(1, 2, 3, 4, 5).values('value')"
    assert [g.query(f"{small}.{f}()").df.first()[0] for f in ("sum", "mean", "max", "min")] == [15.0, 3.0, 5.0, 1.0]
    assert ids(g.query("g.V().has('value', gt(5))").df) == [6, 7, 8, 9, 10]
    assert len(g.query("g.V().has('category', within('low', 'medium'))").df.collect()) == 5
    assert ids(g.query("g.V().hasKey('category').limit(3)").df) == [1, 2, 3] and ids(g.query("g.V().skip(8)").df) == [9, 10]


def test_properties_change(graph, spark):
    g = graph([(1, 2), (2, 3)], [(1, 5), (2, 6), (3, None)], "value bigint")
    gone = g.delete_properties(spark.createDataFrame([(2,), (9,)], "id bigint"), "value", "absent")
    assert {r["id"]: r["value"] for r in gone.vertices.collect()} == {1: 5, 2: None, 3: None}
    marked = g.query("g.V(1).outE().property('kind', 'x')").graph.edges
    assert {(r["src"], r["kind"]) for r in marked.collect()} == {(1, "x"), (2, None)}


def test_cache(graph):
    cache = engine.Cache(graph(chain(1, 2, 3)), most=2)
    for text in ("g.V().count()", "g.V(1)", "g.V().count()", "g.V(2)"):
        cache.query(text).collect()
    assert cache.stats() == {"total_entries": 2, "max_size": 2, "total_accesses": 4} and "g.V().count()" not in cache.held
    cache.clear()
    assert cache.stats()["total_entries"] == 0


def test_cost_model(spark):
    one = spark.range(1).select(F.lit(0.5).alias("l"), F.lit(0.0).alias("none"), F.lit(10.0).alias("d"))
    r = one.select(cost.degree_threshold(F.col("l"), F.col("none"), F.col("d")).alias("a"), cost.degree_threshold(F.col("l"), F.lit(0.5), F.lit(1000.0)).alias("b"), cost.optimal_ratio(F.col("none")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (0, int(1000 * 4096 / 369 - 8192 / 41 - 1 / 41), 1.0)
    values = spark.createDataFrame([(0.2,)] * 50 + [(3.0,)] * 45 + [(9999.0,)] * 5, "t double")
    assert {x["share"]: x["latency"] for x in cost.percentiles(values, "t", [50.0, 95.0, 99.0]).collect()} == {50.0: 0.5, 95.0: 5.0, 99.0: 5000.0}
    assert [x["latency"] for x in cost.percentiles(values.limit(0), "t", [50.0]).collect()] == [0.0]


@pytest.mark.parametrize("text", ["g.V().nothing()", "g.V(", "g.V().out(", "g.V().V()", ""])
def test_errors(graph, text):
    with pytest.raises(QueryError):
        graph(chain(1, 2)).query(text)


def test_point_lookups_reach_the_scan(spark):
    from meshwright.sources.tables import load

    g = load(spark, "/root/testdata/sf0.001", ("in_region",))
    plan = g.query("g.V(3000000007)").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "EqualTo(c_custkey,7)" in plan.split("PushedFilters")[1]
    assert [tuple(r) for r in g.query("g.V(3000000007, 1000000001, 99)").df.orderBy("id").collect()] == [(1000000001,), (3000000007,)]


def test_clamped_counters_in_order(spark):
    from random import Random

    from meshwright.operators.apps import clamped

    rng = Random(3)
    log = [(rng.choice("aab"), i, rng.choice([1, -1, -2, 3, None])) for i in range(400)] + [(None, 1, 1), ("c", None, 1), ("d", 5, -3)]
    want = {"d": 0}
    for key, at, change in log[:400]:
        want[key] = max(0, want.get(key, 0) + (change or 0))
    df = spark.createDataFrame(log, "key string, at long, change int")
    for block in (7, 64, 1 << 16):
        assert {r["key"]: r["n"] for r in clamped(df, "key", "at", "change", block).collect()} == want
    assert clamped(df.limit(0), "key", "at", "change").count() == 0


def test_triangles_and_other_patterns(spark):
    from itertools import permutations
    from random import Random

    from meshwright.operators.algorithms import match

    rng = Random(5)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)} | {(0, i) for i in range(12)} | {(i, 0) for i in range(0, 12, 2)}
    labels = {e: rng.choice("xy") for e in edges}
    df = spark.createDataFrame([(i, s, t, labels[s, t]) for i, (s, t) in enumerate(sorted(edges))], "eid long, src long, dst long, label string")
    vertices = spark.range(12)
    shapes = [
        [("a", "b", None), ("b", "c", None), ("c", "a", None)],
        [("a", "b", "x"), ("a", "c", "y"), ("b", "c", None)],
        [("a", "b", "x"), ("b", "c", None)],
        [("a", "b", "x"), ("b", "a", None)],
        [("a", "b", "x"), ("b", "c", "y"), ("c", "d", "x"), ("a", "d", None)],
    ]
    for shape in shapes:
        names = list(dict.fromkeys(c for s, t, _ in shape for c in (s, t)))
        for where in (None, {"b": "id % 3 > 0"}):
            want = set()
            for ids in permutations(range(12), len(names)):
                at = dict(zip(names, ids))
                if (not where or at["b"] % 3) and all((at[s], at[t]) in edges and label in (None, labels[at[s], at[t]]) for s, t, label in shape):
                    want.add(ids)
            from pyspark.sql import functions as F

            got = match(vertices, df, shape, {c: F.expr(x) for c, x in where.items()} if where else None).select(*names).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want

"""Graph algorithms as loops of joins; each round is settled, so that plans stay small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.settle import settle


def spread(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_source(adj: DataFrame) -> DataFrame:
    """The edges settled once, partitioned by source, for loops that join them with a frontier."""
    return settle(adj.select("src", "dst").repartition(spread(adj), "src"), "adj")


def levels(adj: DataFrame, start: int, max_depth: int | None = None, target: int | None = None) -> list[DataFrame]:
    """Breadth-first levels (id, depth, parent), each settled, until the frontier is empty, ``max_depth`` or the ``target`` is met; the parent is the smallest one."""
    links = by_source(adj)
    none = F.lit(None).cast("long")
    seen, since = None, 0  # ids of the first ``since`` levels, settled together now and then so that plans stay small
    found = [settle(adj.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("depth"), none.alias("parent")), "level")]
    while max_depth is None or len(found) <= max_depth:
        if target is not None and not found[-1].where(F.col("id") == target).isEmpty():
            break
        own = reduce(DataFrame.unionAll, [*([seen] if seen is not None else []), *[f.select("id") for f in found[since:]]])
        if len(found) - since >= 8:
            seen, since = settle(own, "seen"), len(found)
            own = seen
        step = found[-1].select(F.col("id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = settle(step.join(own, "id", "left_anti").select("id", F.lit(len(found)).alias("depth"), "parent"), "level")
        if front.isEmpty():
            break
        found.append(front)
    return found


def bfs(adj: DataFrame, start: int, max_depth: int | None = 10) -> DataFrame:
    """(id, depth, parent) of vertices within ``max_depth`` hops, of all that can be reached if it is None."""
    return reduce(DataFrame.unionAll, levels(adj, start, max_depth))


def shortest_path(adj: DataFrame, start: int, end: int, max_depth: int | None = None) -> DataFrame:
    """(pos, id) of a shortest path, ties by the smallest parent; empty if there is none (of ``max_depth`` hops or fewer)."""
    found = levels(adj, start, max_depth, end)
    at = found[-1].where(F.col("id") == end)  # the search stops at the level of the target, so that it is there or nowhere
    steps = [at]
    for level in reversed(found[:-1]):
        at = level.join(at.select(F.col("parent").alias("id")), "id").select("id", "depth", "parent")
        steps.append(at)
    return reduce(DataFrame.unionAll, steps).select(F.col("depth").alias("pos"), "id")


def dfs(adj: DataFrame, start: int, max_depth: int = 10, most: int | None = None) -> DataFrame:
    """(pos, id, depth) in depth-first preorder, neighbours by id.

    A preorder is a chain of steps, so one task takes them, over all edges within reach, however many. It gets each vertex's
    neighbours in order, keeps them in a file of its own and holds 17 bytes a vertex, 32 while it numbers them. If a caller
    names ``most``, more edges to follow than that raise ValueError before the walk.
    """
    inside = settle(bfs(adj, start, max_depth).where("id IS NOT NULL"), "within")
    ends = inside.where(F.col("depth") < max_depth).select(F.col("id").alias("src"))  # no walk leaves the others: it can't come sooner than the shortest
    near = adj.join(ends, "src", "left_semi").where("src <> dst").select("src", "dst")
    if most is not None:
        near = settle(near, "near")
        if near.count() > most:
            raise ValueError(f"more than {most} edges within {max_depth} hops")
    # A null opens each vertex's neighbours. Each partition is sorted by itself, and the one task reads them one after another.
    runs = inside.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionAll(near)
    runs = runs.repartition(spread(adj), "src").sortWithinPartitions("src", F.asc_nulls_first("dst")).coalesce(1)
    return settle(runs.mapInArrow(preorder(start, max_depth), "pos int, id bigint, depth int"), "dfs")


def preorder(start: int, max_depth: int, block: int = 1 << 16):
    """For one partition of rows (src, dst), each vertex's together: a null, then its neighbours in order, which are vertices too."""

    def told(frames):
        import os
        import tempfile
        from array import array
        from itertools import chain, islice

        import numpy as np
        import pyarrow as pa

        with tempfile.TemporaryFile() as file:
            ids, at, m = [], [], 0  # vertices as they come, and where in the file their neighbours begin
            for frame in frames:
                src, dst = frame.column("src"), frame.column("dst")
                opens = np.flatnonzero(dst.is_null().to_numpy(zero_copy_only=False))
                ids.append(src.to_numpy()[opens])
                at.append(m + opens - np.arange(len(opens)))
                m += file.write(dst.drop_null().to_numpy()) // 8
            file.flush()
            n, held = sum(map(len, ids)), file.fileno()
            ids, at = np.concatenate(ids), np.concatenate([*at, [m]])
            order = np.argsort(ids)
            by_id = ids[order]

            def numbers(some):
                return order[np.searchsorted(by_id, some)]

            for a in range(0, m, block):
                os.pwrite(held, numbers(np.frombuffer(os.pread(held, 8 * block, 8 * a), "int64")), 8 * a)
            first = int(numbers(start))
            del order, by_id
            begins = memoryview(at)

            def after(v: int):
                lo, hi = begins[v], begins[v + 1]
                return chain.from_iterable(array("q", os.pread(held, 8 * min(block, hi - a), 8 * a)) for a in range(lo, hi, block))

            def walk():
                seen = bytearray(n)
                seen[first] = 1
                yield first, 0
                open_ = [after(first)] if max_depth > 0 else []
                while open_:
                    for v in open_[-1]:
                        if not seen[v]:
                            seen[v] = 1
                            yield v, len(open_)
                            if len(open_) < max_depth:
                                open_.append(after(v))
                                break
                    else:
                        open_.pop()

            steps, pos = walk(), 0
            while some := list(islice(steps, block)):
                v, depth = np.array(some, "int64").T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + len(some), dtype="int32")), pa.array(ids[v]), pa.array(depth.astype("int32"))], ["pos", "id", "depth"])
                pos += len(some)

    return told


def sssp(adj: DataFrame, start: int) -> DataFrame:
    return bfs(adj, start, None).select("id", F.col("depth").cast("double").alias("distance"))


def k_hop(adj: DataFrame, start: int, k: int, shortest: bool = False) -> DataFrame:
    """(level, id): ends of walks of exactly ``level`` edges, or with ``shortest`` the breadth-first levels."""
    if shortest:
        return bfs(adj, start, k).where("depth > 0").select(F.col("depth").alias("level"), "id")
    front = adj.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"))
    levels = []
    for level in range(1, k + 1):
        front = front.select(F.col("id").alias("src")).join(adj, "src").select(F.col("dst").alias("id")).distinct()
        levels.append(front.select(F.lit(level).alias("level"), "id"))
    return reduce(DataFrame.unionAll, levels)


def pagerank(vertices: DataFrame, adj: DataFrame, damping: float = 0.85, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """(id, score). Mass of vertices without out-edges is dropped; the out-degree counts all neighbours.

    The edge table is partitioned by source once; each round joins it with the scores and sums by target before the shuffle.
    """
    n = vertices.count()
    degree = adj.groupBy("src").agg(F.count("*").alias("degree"))
    links = settle(adj.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").join(degree, "src").repartition(spread(adj), "src"))
    ids = settle(vertices.select("id"))
    scores = ids.withColumn("score", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        sent = links.join(scores.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        new = settle(scores.join(sent, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old")))
        scores = new.select("id", "score")
        if tolerance and new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] < tolerance:
            break
    return scores


def components(vertices: DataFrame, adj: DataFrame) -> DataFrame:
    """(id, component): weak components of the subgraph of ``vertices`` by least label, with pointer jumping."""
    ids = vertices.select("id")
    inner = adj.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    inner = inner.select("src", "dst")  # a semi-join moves its key to the front
    edges = settle(inner.unionAll(inner.select("dst", "src")).distinct().repartition(spread(adj), "src"))
    state = settle(ids.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        step = state.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = step.join(state.select(F.col("id").alias("new"), F.col("component").alias("root")), "new").select("id", "old", F.least("new", "root").alias("component"))
        jump = settle(jump)
        state = jump.select("id", "component")
        if jump.where("old <> component").isEmpty():
            return state


def range_summary(vertices: DataFrame, adj: DataFrame, a: int, b: int) -> DataFrame:
    """One row: sources in [a, b], edges inside the range, and their density."""
    n = adj.where(F.col("src").between(a, b)).agg(F.countDistinct("src").alias("n_vertices"), F.count_if(F.col("dst").between(a, b)).alias("n_edges"))
    return n.withColumn("density", F.when(F.col("n_vertices") > 1, F.col("n_edges") / (F.col("n_vertices") * (F.col("n_vertices") - 1))).otherwise(0.0))


def multi_range(adj: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """One row a range, by start; the ranges are a small literal list."""
    frames = [range_summary(None, adj, a, b).select(F.lit(i).alias("range_no"), "*") for i, (a, b) in enumerate(sorted(ranges))]
    return reduce(DataFrame.unionAll, frames)


def range_bfs(adj: DataFrame, start: int, a: int, b: int, max_depth: int = 10) -> DataFrame:
    return bfs(adj, start, max_depth).select("id", "depth", F.col("id").between(a, b).alias("in_range"))


def range_aware_distances(adj: DataFrame, start: int, ranges: list[tuple[int, int]], inside: float = 0.8) -> DataFrame:
    """(id, weight): least path weight, where a hop into a preferred range costs ``inside`` and any other 1; by relaxation."""
    hit = reduce(lambda x, y: x | y, [F.col("dst").between(a, b) for a, b in ranges], F.lit(False))
    edges = settle(adj.select("src", "dst", F.when(hit, inside).otherwise(1.0).alias("w")))
    best = settle(adj.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0.0).alias("weight")))
    front = best
    while True:
        near = front.withColumnRenamed("id", "src").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.round(F.col("weight") + F.col("w"), 9)).alias("near"))
        merged = settle(best.join(near, "id", "full").select("id", F.least("weight", "near").alias("weight"), (F.col("near") < F.coalesce("weight", F.lit(float("inf")))).alias("better")))
        best, front = merged.select("id", "weight"), settle(merged.where("better").select("id", "weight"))
        if front.isEmpty():
            return best


def range_aware_path(adj: DataFrame, start: int, end: int, ranges: list[tuple[int, int]], inside: float = 0.8) -> DataFrame:
    """(pos, id, weight) of a lightest path by range_aware_distances, ties by the smallest predecessor; empty if there is none."""
    best = settle(range_aware_distances(adj, start, ranges, inside))
    hit = reduce(lambda x, y: x | y, [F.col("dst").between(a, b) for a, b in ranges], F.lit(False))
    from_, to = (best.select(F.col("id").alias(c), F.col("weight").alias(f"w_{c}")) for c in ("src", "dst"))
    steps = adj.where(F.col("dst") != start).select("src", "dst", F.when(hit, inside).otherwise(1.0).alias("w")).join(from_, "src").join(to, "dst")
    light = steps.where(F.round(F.col("w_src") + F.col("w"), 9) == F.col("w_dst"))
    parent = settle(light.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")))
    rows = best.where(F.col("id") == end)
    at = settle(rows.join(parent, "id", "left").select("id", "weight", "parent"))
    path = [at]
    while not at.where("parent IS NOT NULL").isEmpty():  # one row a step
        up = at.select(F.col("parent").alias("id")).join(best, "id")
        at = settle(up.join(parent, "id", "left").select("id", "weight", "parent"))
        path.append(at)
    n = len(path)
    return reduce(DataFrame.unionAll, [d.select(F.lit(n - 1 - i).alias("pos"), "id", "weight") for i, d in enumerate(path)])


def match(vertices: DataFrame, edges: DataFrame, pattern: list[tuple[str, str, str | None]], where: dict | None = None, limit: int | None = None, least: int = 0) -> DataFrame:
    """All injective matches: one column a pattern vertex. ``pattern``: (from, to, edge label); ``where``: a Column of vertex properties by pattern vertex.

    Tests of vertices apply to the edges before any join. A triangle is found from its corner of least degree, so that a
    hub's pairs of neighbours are never listed; other patterns join their edges in the order given.
    """
    passing = {c: vertices.where(test).select(F.col("id").alias(c)) for c, test in (where or {}).items()}

    def pairs(s: str, t: str, table: DataFrame) -> DataFrame:
        rows = table.select(F.col("src").alias(s), F.col("dst").alias(t))
        for c in (s, t):
            rows = rows.join(passing[c], c, "left_semi") if c in passing else rows
        return rows.select(s, t)

    def plain(label: str | None) -> DataFrame:
        return (edges if label is None else edges.where(F.col("label") == label)).select("src", "dst").where("src <> dst").distinct()

    names = list(dict.fromkeys(c for s, t, _ in pattern for c in (s, t)))
    if len(pattern) == 3 and len(names) == 3 and len({frozenset(e[:2]) for e in pattern}) == 3:
        rows = triangles({label: plain(label) for _, _, label in pattern}, pattern, pairs)
    else:
        rows, bound = None, []
        for s, t, label in pattern:
            e, known = pairs(s, t, plain(label)), [c for c in (s, t) if c in bound]
            rows = e if rows is None else rows.join(e, known) if known else rows.crossJoin(e)  # a pattern of parts that don't touch is a product
            for c in (s, t):
                if c not in bound:
                    for b in bound:
                        rows = rows.where(F.col(c) != F.col(b))
                    bound.append(c)
    rows = rows.select(*names)
    if least and rows.limit(least).count() < least:
        return rows.limit(0)
    return rows if limit is None else rows.orderBy(*names).limit(limit)


def triangles(tables: dict, pattern: list[tuple[str, str, str | None]], pairs) -> DataFrame:
    """Matches of three pattern edges over three vertices. Each has one corner of least rank (degree, then id); the two edges
    at that corner meet first, both leading to higher ranks, and the third edge closes them: at most m ** 1.5 pairs."""
    ends = reduce(DataFrame.unionAll, tables.values()).select(F.explode(F.array("src", "dst")).alias("id"))
    ranks = ends.groupBy("id").agg(F.count("*").alias("degree")).select("id", F.struct("degree", "id").alias("rank"))
    from_, to = (ranks.select(F.col("id").alias(c), F.col("rank").alias(f"r_{c}")) for c in ("src", "dst"))
    ranked = {label: settle(t.join(from_, "src").join(to, "dst").select("src", "dst", (F.col("r_src") < F.col("r_dst")).alias("up"))) for label, t in tables.items()}
    found = []
    for low in dict.fromkeys(c for s, t, _ in pattern for c in (s, t)):
        one, two = (pairs(s, t, ranked[label].where(F.col("up") if s == low else ~F.col("up"))) for s, t, label in pattern if low in (s, t))
        s, t, label = next(e for e in pattern if low not in e[:2])
        found.append(one.join(two, low).where(F.col(s) != F.col(t)).join(pairs(s, t, ranked[label]), [s, t]))
    return reduce(DataFrame.unionByName, found)


def random_walk(adj: DataFrame, start: int, hops: int = 5, seed: int = 12345) -> DataFrame:
    """(pos, id): each next vertex is the neighbour of least seeded hash."""
    front = adj.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("pos"))
    out = front
    for h in range(1, hops + 1):
        front = front.select(F.col("id").alias("src")).join(adj, "src").agg(F.min(F.struct(F.xxhash64("dst", F.lit(seed + h)).alias("h"), F.col("dst").alias("d"))).alias("m")).where("m IS NOT NULL").select(F.col("m.d").alias("id"), F.lit(h).alias("pos"))
        out = out.unionAll(front)
    return out.select("pos", "id")


def network_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = vertices.agg(F.count("*").alias("n_vertices"))
    e = edges.agg(F.count("*").alias("n_edges"))
    n, m = F.col("n_vertices"), F.col("n_edges")
    return v.join(e, F.lit(True)).select(n, m, F.when(n > 0, 2 * m / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, m / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))


def locality(adj: DataFrame) -> DataFrame:
    """(id, score): exp(-mean gap / 1e6) over a vertex's sorted neighbours, whose gaps add up to the distance of the ends."""
    span = F.max("dst") - F.min("dst")
    return adj.groupBy(F.col("src").alias("id")).agg(F.exp(-span / F.greatest(F.count("*") - 1, F.lit(1)) / 1e6).alias("score"))

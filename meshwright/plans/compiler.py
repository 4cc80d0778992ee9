"""Steps to one lazy DataFrame.

A frame has one row a traverser. ``cur`` is where it stands: a vertex id, an edge id or a value. Columns named p_<key>
hold properties of the element, joined in only when a step asks for one; columns that begin with __ or @ (path, bound
labels, traverser numbers) travel along. Catalyst prunes what a later step doesn't use.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.predicates import P
from meshwright.plans.parser import Name, QueryError, Step
from meshwright.settle import settle

MAX_DEPTH = 10
_number = count()


@dataclass(frozen=True)
class Frame:
    graph: object
    rows: DataFrame
    kind: str  #: vertex, edge, value, map, table
    saved: dict = field(default_factory=dict)
    sort: tuple = ()  #: sort expressions in force
    scope: str | None = None  #: a traverser column within which limit, count and the like work

    def on(self, rows: DataFrame, kind: str | None = None, **more) -> Frame:
        return replace(self, rows=rows, kind=kind or self.kind, **more)

    @property
    def carried(self) -> list[str]:
        return [c for c in self.rows.columns if c.startswith(("__", "@"))]

    def type_of(self, column: str) -> str:
        return dict(self.rows.dtypes)[column]

    @property
    def df(self) -> DataFrame:
        """The result: id; eid, src, dst, label; value; or the table's own columns."""
        rows, own = self.rows, [c for c in self.rows.columns if c.startswith("@")]
        if self.sort:
            rows = rows.orderBy(*self.sort)
        if self.kind == "vertex":
            return rows.select(F.col("cur").alias("id"), *own)
        if self.kind == "edge":
            return rows.select(F.col("cur").alias("eid"), "src", "dst", F.col("p_label").alias("label"))
        if self.kind == "value":
            return rows.select(F.col("cur").alias("value"))
        return rows.select(*[c for c in rows.columns if not c.startswith("__")])


def is_steps(x: object) -> bool:
    return isinstance(x, tuple) and bool(x) and all(isinstance(s, Step) for s in x)


def mentions(steps: tuple, name: str) -> bool:
    return any(s.name == name or any(mentions(a, name) for a in s.args if is_steps(a)) for s in steps)


def compile_steps(graph, steps: tuple[Step, ...]) -> Frame:
    if not steps or steps[0].name not in ("V", "E", "addV"):
        raise QueryError("a query begins with V, E or addV")
    return run(steps, Frame(graph, graph.vertices.limit(0), "start"), mentions(steps, "path"))


def run(steps: tuple[Step, ...], f: Frame, paths: bool = False) -> Frame:
    i = 0
    while i < len(steps):
        step, i = steps[i], i + 1
        after: list[Step] = []
        wanted = {"repeat": ("times", "until", "emit"), "order": ("by",), "group": ("by",), "groupCount": ("by",), "project": ("by",), "addE": ("to", "from")}.get(step.name, ())
        while i < len(steps) and steps[i].name in wanted:
            after.append(steps[i])
            i += 1
        handler = HANDLERS.get(step.name)
        if handler is None:
            raise QueryError(f"no step is named {step.name}")
        if step.name in ("V", "E") and f.kind != "start":
            raise QueryError(f"{step.name} can't stand inside a traversal")
        f = handler(f, step.args, after)
        if paths and f.kind == "vertex" and step.name in MOVES:
            old = F.col("__path") if "__path" in f.rows.columns else F.array().cast("array<bigint>")
            f = f.on(f.rows.withColumn("__path", F.array_append(old, F.col("cur"))))
    return f


# Sources


def start_v(f: Frame, args, after) -> Frame:
    g = f.graph
    rows = g.lookup(list(args)) if args else g.vertices
    return f.on(rows.select(F.col("id").alias("cur"), F.col("label").alias("p_label"), *[F.col(k).alias(f"p_{k}") for k in g.vertex_keys]), "vertex")


def edge_columns(g) -> list:
    return ["src", "dst", F.col("label").alias("p_label"), *[F.col(k).alias(f"p_{k}") for k in g.edge_keys]]


def start_e(f: Frame, args, after) -> Frame:
    rows = f.graph.edges.where(F.col("eid").isin(*args)) if args else f.graph.edges
    return f.on(rows.select(F.col("eid").alias("cur"), *edge_columns(f.graph)), "edge")


# Movement


def need(f: Frame, *kinds: str) -> None:
    if f.kind not in kinds:
        raise QueryError(f"the step needs {' or '.join(kinds)}, not {f.kind}")


def hop(f: Frame, labels, here: str, there: str) -> DataFrame:
    pairs = f.graph.pairs(*labels).select(F.col(here).alias("cur"), F.col(there).alias("__to"))
    return f.rows.select("cur", *f.carried).join(pairs, "cur").select(F.col("__to").alias("cur"), *f.carried)


def out(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(hop(f, labels, "src", "dst"), sort=())


def in_(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(hop(f, labels, "dst", "src"), sort=())


def both(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(hop(f, labels, "src", "dst").unionByName(hop(f, labels, "dst", "src")), sort=())


def edges_of(f: Frame, labels, here: str) -> DataFrame:
    g = f.graph
    edges = g.edges.where(F.col("label").isin(*labels)) if labels else g.edges
    carried = [c for c in f.carried if c != "__from"]
    edges = edges.select(F.col("eid").alias("__eid"), *edge_columns(g)).withColumn("cur", F.col(here))
    joined = f.rows.select("cur", *carried).join(edges, "cur").withColumn("__from", F.col("cur"))
    return joined.withColumn("cur", F.col("__eid")).drop("__eid")


def out_e(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(edges_of(f, labels, "src"), "edge", sort=())


def in_e(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(edges_of(f, labels, "dst"), "edge", sort=())


def both_e(f: Frame, labels, after) -> Frame:
    need(f, "vertex")
    return f.on(edges_of(f, labels, "src").unionByName(edges_of(f, labels, "dst")), "edge", sort=())


def endpoint(column):
    def step(f: Frame, args, after) -> Frame:
        need(f, "edge")
        c = column() if callable(column) else F.col(column)
        return f.on(f.rows.select(c.alias("cur"), *[x for x in f.carried if x != "__from"]), "vertex", sort=())

    return step


def other() -> object:
    return F.when(F.col("__from") == F.col("src"), F.col("dst")).otherwise(F.col("src"))


# Filters


def with_props(f: Frame, keys) -> Frame:
    """The frame with columns p_<key>; unknown keys are null."""
    lack = [k for k in dict.fromkeys(keys) if f"p_{k}" not in f.rows.columns]
    if not lack:
        return f
    own = ["label", *f.graph.vertex_keys] if f.kind == "vertex" else []
    rows, there = f.rows, [k for k in lack if k in own]
    if there:
        rows = rows.join(f.graph.vertices.select(F.col("id").alias("cur"), *[F.col(k).alias(f"p_{k}") for k in there]), "cur", "left")
    for k in lack:
        if k not in own:
            rows = rows.withColumn(f"p_{k}", F.lit(None).cast("string"))
    return f.on(rows)


def keys_of(f: Frame) -> list[str]:
    return f.graph.vertex_keys if f.kind == "vertex" else f.graph.edge_keys


def has_label(f: Frame, labels, after) -> Frame:
    if f.kind not in ("vertex", "edge"):
        return f
    f = with_props(f, ["label"])
    return f.on(f.rows.where(F.col("p_label").isin(*labels)))


def has(f: Frame, args, after) -> Frame:
    need(f, "vertex", "edge")
    key, *rest = args
    f = with_props(f, [key])
    c = F.col(f"p_{key}")
    if not rest:
        return f.on(f.rows.where(c.isNotNull()))
    p = rest[0] if isinstance(rest[0], P) else P("eq", (rest[0],))
    return f.on(f.rows.where(c.isNotNull() & p.column(c, f.type_of(f"p_{key}"))))


def has_id(f: Frame, ids, after) -> Frame:
    return f.on(f.rows.where(F.col("cur").isin(*ids)))


def has_value(f: Frame, args, after) -> Frame:
    f = with_props(f, keys_of(f))
    test = F.lit(False)
    for k in keys_of(f):
        test = test | P("eq", args).column(F.col(f"p_{k}"), f.type_of(f"p_{k}"))
    return f.on(f.rows.where(test))


def ids_of(f: Frame, x) -> DataFrame:
    if isinstance(x, str):
        if x not in f.saved:
            return f.rows.select("cur").limit(0)
        return f.saved[x].select("cur").distinct()
    start = Frame(f.graph, f.rows, "start", f.saved)
    return (run(x, start) if x[0].name in ("V", "E") else run(x, f)).rows.select("cur").distinct()


def numbered(f: Frame) -> tuple[Frame, str]:
    """The frame with a number for each traverser, settled so that it can't change."""
    tid = f"__t{next(_number)}"
    return f.on(settle(f.rows.withColumn(tid, F.monotonically_increasing_id()))), tid


def where(f: Frame, args, after) -> Frame:
    p = args[0]
    if is_steps(p):
        if len(p) == 1 and p[0].name == "hasProperty":
            return has(f, p[0].args, after)
        if len(p) == 1 and p[0].name in ("without", "within", "neq"):
            return where(f, (P(p[0].name, p[0].args),), after)
        if f.kind in ("vertex", "edge") and not f.carried:
            # The test depends on the element alone, so each is asked once, by its own id.
            tid = f"__t{next(_number)}"
            asked = f.on(f.rows.dropDuplicates(["cur"]).withColumn(tid, F.col("cur")))
            hits = run(p, asked).rows.select(F.col(tid).alias("cur")).distinct()
            return f.on(f.rows.join(hits, "cur", "left_semi"))
        f, tid = numbered(f)
        hits = run(p, f).rows.select(tid).distinct()
        return f.on(f.rows.join(hits, tid, "left_semi").drop(tid))
    if p.name in ("neq", "within", "without") and p.args and (is_steps(p.args[0]) or (f.kind == "vertex" and isinstance(p.args[0], str))):
        return f.on(f.rows.join(ids_of(f, p.args[0]), "cur", "left_semi" if p.name == "within" else "left_anti"))
    return f.on(f.rows.where(p.column(F.col("cur"), f.type_of("cur"))))


def named_predicate(name):
    return lambda f, args, after: where(f, (P(name, args),), after)


def dedup(f: Frame, args, after) -> Frame:
    own = ["cur"] if f.kind != "map" else f.rows.columns
    if f.scope:
        own = [*own, f.scope]
    extra = [c for c in f.carried if c not in own]
    if not extra:
        keep = [*own, *[c for c in f.rows.columns if c not in own]]
        return f.on(f.rows.select(*keep).dropDuplicates(own), sort=())
    first = F.min(F.struct(*extra)).alias("__x")
    rows = f.rows.groupBy(*own).agg(first).select(*own, "__x.*")
    f2 = f.on(rows, sort=())
    return f2 if f.kind != "edge" else f.on(f.rows.dropDuplicates(own), sort=())


# Projection


def values(f: Frame, keys, after) -> Frame:
    need(f, "vertex", "edge")
    keys = keys or keys_of(f)
    f = with_props(f, keys)
    kinds = {f.type_of(f"p_{k}") for k in keys}
    one = kinds.pop() if len(kinds) == 1 else ("double" if kinds <= {"bigint", "int", "double"} else "string")
    if len(keys) == 1:
        c = F.col(f"p_{keys[0]}")
        rows = f.rows.where(c.isNotNull()).withColumn("__value", c)
    else:
        array = F.array(*[F.col(f"p_{k}").cast(one) for k in keys])
        rows = f.rows.withColumn("__value", F.explode(F.filter(array, lambda x: x.isNotNull())))
    return f.on(rows.select(F.col("__value").alias("cur"), *f.carried), "value")


def property_map(f: Frame, keys, after) -> Frame:
    keys = keys or keys_of(f)
    f = with_props(f, keys)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p_{k}").cast("string").alias("v")) for k in keys]), lambda x: x["v"].isNotNull())
    return f.on(f.rows.select(F.col("cur"), F.map_from_entries(pairs).alias("props"), *f.carried), "map")


def project(f: Frame, names, after) -> Frame:
    need(f, "vertex", "edge")
    parts = []
    for i, n in enumerate(names):
        by = after[i].args[0] if i < len(after) and after[i].args else n
        if by == "id" or (is_steps(by) and by[0].name == "id"):
            column = F.col("cur")
        else:
            f, name = by_value(f, by)
            column = F.col(name)
        parts.append((n, column))
    columns = [c.alias(n) for n, c in parts]
    return f.on(f.rows.select(*columns, *f.carried), "table")


def id_(f: Frame, args, after) -> Frame:
    return f.on(f.rows.select("cur", *f.carried), "value")


def as_(f: Frame, args, after) -> Frame:
    return f.on(f.rows.withColumn(f"@{args[0]}", F.col("cur")))


def select(f: Frame, names, after) -> Frame:
    if len(names) == 1:
        return f.on(f.rows.select(F.col(f"@{names[0]}").alias("cur"), *f.carried), "value")
    return f.on(f.rows.select(*[F.col(f"@{n}").alias(n) for n in names]), "table")


def path(f: Frame, args, after) -> Frame:
    return f.on(f.rows.select(F.col("__path").alias("cur")), "value")


def by_value(f: Frame, by) -> tuple[Frame, str]:
    """The frame with a column for a by-modulator: a property's name or a sub-traversal's value."""
    name = f"__b{next(_number)}"
    if isinstance(by, Name):
        by = by.word
    if isinstance(by, str):
        f = with_props(f, [by])
        return f.on(f.rows.withColumn(name, F.col(f"p_{by}"))), name
    key = f"__k{next(_number)}"
    ends = f.on(f.rows.select("cur").distinct().withColumn(key, F.col("cur")), scope=key, sort=())
    got = run(by, ends).rows.groupBy(key).agg(F.max("cur").alias(name))
    zero = F.lit(0).cast("bigint") if by[-1].name == "count" else F.lit(None)
    rows = f.rows.join(got.withColumnRenamed(key, "cur"), "cur", "left").withColumn(name, F.coalesce(name, zero))
    return f.on(rows), name


# Aggregation


def gathered(f: Frame, agg, kind: str = "value") -> Frame:
    if f.scope:
        return f.on(f.rows.groupBy(f.scope).agg(agg.alias("cur")), kind, sort=())
    return f.on(f.rows.agg(agg.alias("cur")), kind, sort=())


def count_(f: Frame, args, after) -> Frame:
    return gathered(f, F.count("*"))


def number(f: Frame):
    return F.col("cur").cast("double") if f.type_of("cur") in ("bigint", "int", "double", "float") else F.lit(None).cast("double")


def folding(make):
    return lambda f, args, after: gathered(f, make(number(f)))


def fold(f: Frame, args, after) -> Frame:
    return gathered(f, F.array_sort(F.collect_list("cur")))


def keyed(f: Frame, after) -> Frame:
    if after and after[0].args:
        f, name = by_value(f, after[0].args[0])
        return f.on(f.rows.where(F.col(name).isNotNull()).withColumn("__key", F.col(name)))
    return f.on(f.rows.withColumn("__key", F.col("cur")))


def group_count(f: Frame, args, after) -> Frame:
    return f.on(keyed(f, after).rows.groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("cnt")), "table", sort=())


def group(f: Frame, args, after) -> Frame:
    return f.on(keyed(f, after).rows.groupBy(F.col("__key").alias("key")).agg(F.array_sort(F.collect_list("cur")).alias("members")), "table", sort=())


def store(f: Frame, args, after) -> Frame:
    return replace(f, saved={**f.saved, args[0]: f.rows})


# Order and limits


def order(f: Frame, args, after) -> Frame:
    if args and isinstance(args[0], Name) and args[0].word == "local":  # of a group count: its entries
        by = after[0].args if after else ()
        words = [a.word for a in by if isinstance(a, Name)]
        size = F.col("cnt") if "cnt" in f.rows.columns else F.size("members")
        column = F.col("key") if "keys" in words else size
        first = column.desc() if "desc" in words else column.asc()
        return replace(f, sort=(first, F.col("key").asc()))
    sort = []
    for s in after:
        down = any(isinstance(a, Name) and a.word == "desc" for a in s.args[1:])
        if s.args and not (isinstance(s.args[0], Name) and s.args[0].word in ("asc", "desc")):
            f, name = by_value(f, s.args[0])
        else:
            name, down = "cur", bool(s.args) and s.args[0].word == "desc"
        sort.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return replace(f, sort=(*sort, F.col("cur").asc()))


def window(f: Frame, skip: int, take: int | None) -> Frame:
    sort = f.sort or ((F.col("cur").asc(),) if "cur" in f.rows.columns else (F.col("key").asc(),))
    if f.scope:
        rows = f.rows.withColumn("__n", F.row_number().over(Window.partitionBy(f.scope).orderBy(*sort)))
        test = F.col("__n") > skip
        return f.on(rows.where(test if take is None else test & (F.col("__n") <= skip + take)).drop("__n"))
    if skip and take is None:
        return f.on(after_first(f.rows, skip, sort), sort=f.sort)
    rows = f.rows.orderBy(*sort)
    rows = rows.offset(skip) if skip else rows
    return f.on(rows if take is None else rows.limit(max(0, take)), sort=f.sort)


def after_first(rows: DataFrame, skip: int, sort) -> DataFrame:
    """``rows`` behind the first ``skip`` in order: numbered inside range partitions, whose sizes, a row each, give the offsets."""
    placed = settle(rows.orderBy(*sort).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    numbered_ = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*sort)))
    return numbered_.join(F.broadcast(offsets), "__p").where(F.col("__before") + F.col("__n") > skip).drop("__p", "__n", "__before")


# Branching


def union(f: Frame, branches, after) -> Frame:
    done = [run(b, f) for b in branches]
    if len({d.kind for d in done}) > 1:
        raise QueryError("branches of a union end on different kinds")
    rows = done[0].rows
    for d in done[1:]:
        rows = rows.unionByName(d.rows, allowMissingColumns=True)
    return done[0].on(rows, sort=())


def choose(f: Frame, args, after) -> Frame:
    test, then, *rest = args
    f, tid = numbered(f)
    yes = where(f, (test,), [])
    no = f.on(f.rows.join(yes.rows.select(tid), tid, "left_anti"))
    ends = [run(then, yes), run(rest[0], no) if rest else no]
    return ends[0].on(ends[0].rows.unionByName(ends[1].rows, allowMissingColumns=True).drop(tid), sort=())


def coalesce(f: Frame, branches, after, itself: bool = False) -> Frame:
    f, tid = numbered(f)
    left, done = f, []
    for b in branches:
        got = run(b, left)
        done.append(got)
        left = left.on(left.rows.join(got.rows.select(tid).distinct(), tid, "left_anti"))
    if itself:
        done.append(left)
    rows = done[0].rows
    for d in done[1:]:
        rows = rows.unionByName(d.rows, allowMissingColumns=True)
    return done[0].on(rows.drop(tid), sort=())


def local(f: Frame, args, after) -> Frame:
    f, tid = numbered(f)
    outer = f.scope
    got = run(args[0], replace(f, scope=tid))
    return replace(got.on(got.rows.drop(tid)), scope=outer)


def repeat(f: Frame, args, after) -> Frame:
    body = args[0]
    given = {s.name: s.args for s in after}
    times = given["times"][0] if "times" in given else args[1] if len(args) > 1 else MAX_DEPTH
    paths = "__path" in f.rows.columns
    out_, last = [], f
    for _ in range(times):
        last = run(body, last, paths)
        if "emit" in given:
            seen = where(last, (given["emit"][0],), []) if given["emit"] else last
            out_.append(seen)
        if "until" in given:
            last, tid = numbered(last)
            done = where(last, (given["until"][0],), [])
            if "emit" not in given:
                out_.append(done.on(done.rows.drop(tid)))
            last = last.on(last.rows.join(done.rows.select(tid), tid, "left_anti").drop(tid))
            if last.rows.isEmpty():
                break
    if "emit" not in given and "until" not in given:
        return last
    rows = out_[0].rows
    for d in out_[1:]:
        rows = rows.unionByName(d.rows, allowMissingColumns=True)
    return out_[0].on(rows, sort=())


# Mutation: the frame's graph becomes a new one.


def add_v(f: Frame, args, after) -> Frame:
    g = f.graph
    new = g.vertices.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("id")).withColumn("label", F.lit(args[0] if args else "vertex"))
    g2 = g.add_vertices(new)
    rows = new.select(F.col("id").alias("cur"), F.col("label").alias("p_label"))
    return Frame(g2, rows, "vertex", f.saved)


def add_e(f: Frame, args, after) -> Frame:
    """Edges between the traversers and the ends that to() or from() names: the one product that the language asks for."""
    need(f, "vertex")
    g, side = f.graph, after[0]
    ends = run(side.args[0], Frame(g, f.rows, "start", f.saved)).rows.select(F.col("cur").alias("__end"))
    pairs = f.rows.select("cur").crossJoin(ends)
    src, dst = ("cur", "__end") if side.name == "to" else ("__end", "cur")
    fresh = pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(args[0]).alias("label"))
    fresh = fresh.withColumn("eid", F.shiftrightunsigned(F.xxhash64("src", "dst", "label"), 1))
    g2 = g.add_edges(fresh)
    rows = fresh.select(F.col("eid").alias("cur"), "src", "dst", F.col("label").alias("p_label"))
    return Frame(g2, rows, "edge", f.saved)


def set_property(f: Frame, args, after) -> Frame:
    key, value = args
    if f.kind == "edge":
        g2 = f.graph.set_edge_property(f.rows.select(F.col("cur").alias("eid")), key, value)
        return Frame(g2, f.rows.withColumn(f"p_{key}", F.lit(value)), "edge", f.saved)
    need(f, "vertex")
    g2 = f.graph.set_property(f.rows.select(F.col("cur").alias("id")), key, value)
    return Frame(g2, f.rows.withColumn(f"p_{key}", F.lit(value)), "vertex", f.saved)


MOVES = ("V", "out", "in", "both", "outV", "inV", "otherV")
HANDLERS = {
    "V": start_v, "E": start_e, "out": out, "in": in_, "both": both, "outE": out_e, "inE": in_e, "bothE": both_e,
    "outV": endpoint("src"), "inV": endpoint("dst"), "otherV": endpoint(other),
    "hasLabel": has_label, "has": has, "hasKey": has, "hasId": has_id, "hasValue": has_value, "where": where, "filter": where,
    "within": named_predicate("within"), "without": named_predicate("without"), "dedup": dedup,
    "values": values, "properties": values, "propertyMap": property_map, "project": project, "id": id_, "as": as_, "select": select, "path": path,
    "count": count_, "sum": folding(lambda x: F.coalesce(F.sum(x), F.lit(0.0))), "mean": folding(lambda x: F.coalesce(F.avg(x), F.lit(0.0))), "max": folding(F.max), "min": folding(F.min),
    "fold": fold, "groupCount": group_count, "group": group, "aggregate": store, "store": store,
    "order": order, "limit": lambda f, a, s: window(f, 0, a[0]), "skip": lambda f, a, s: window(f, a[0], None), "range": lambda f, a, s: window(f, a[0], max(0, a[1] - a[0])),
    "union": union, "choose": choose, "optional": lambda f, a, s: coalesce(f, a, s, itself=True), "coalesce": coalesce, "local": local, "sideEffect": lambda f, a, s: f, "repeat": repeat,
    "addV": add_v, "addE": add_e, "property": set_property,
}

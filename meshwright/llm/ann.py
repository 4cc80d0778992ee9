"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables has HASHES functions floor((a.x + b) / w) with Gaussian,
within a table orthogonal, directions a. The width w is WIDTH for projections a.x
of standard deviation SPREAD and goes with the measured one. A query visits PROBES buckets a table,
its own first, then perturbed ones in the order of their estimated success
(smallest summed squared distance to the crossed boundaries). Candidates of all
tables are merged and reranked by exact Euclidean distance.

Vectors and probes meet by (table, bucket, block); a probe is an id until its bucket's blocks are known, and
no side is broadcast. A bucket's vectors are dealt
over blocks of about BLOCK rows, counted beforehand, so that a large bucket is
spread over tasks and none is capped; a probe goes to every block of its bucket.
Each task keeps the ``k`` nearest of each query that it meets, for HELD queries at a time.

A query that met fewer than ``k`` candidates, or whose buckets hold a vector at
the distance of its k-th candidate with a probability under SURE, is then held
against all vectors, which are dealt over blocks of about EXACT rows.

Defined cases: vectors that are null, zero, of another length than the
most frequent one (of equals the shorter), or hold null or non-finite components take no part, as rows or as
queries; a null id takes no part; repeated rows with one id are one candidate; a
query with fewer than ``k`` candidates in the table gets them all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import cut, spread_of

TABLES, HASHES, WIDTH, PROBES = 2, 8, 0.4, 224
BLOCK = 128
SPREAD, SURE, EXACT, HELD = 0.125, 0.9, 1024, 20_000


class Family:
    """The hash functions of all tables, the same for a seed and a dimension anywhere."""

    def __init__(self, dim: int, seed: int = 7, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.tables, self.hashes = width, tables, hashes
        self.a = [np.concatenate([np.linalg.qr(rng.normal(size=(dim, min(dim, hashes - i))))[0] for i in range(0, hashes, dim)], 1) for _ in range(tables)]
        self.b = [rng.uniform(0, width, hashes) for _ in range(tables)]
        self.mix = rng.integers(1, 2**62, hashes, dtype=np.int64) | 1

    def project(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * self.mix).sum(-1) * 2 + table
            return h ^ (h >> 29)


def probe_sets(fraction: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Perturbations (function, -1 or 1) in the order of estimated success; the first is none."""
    m = len(fraction)
    cost = np.concatenate([fraction**2, (1 - fraction) ** 2])
    order = np.argsort(cost, kind="stable")
    cost = cost[order].tolist()
    move = [(int(i) % m, -1 if i < m else 1) for i in order]
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if len({move[j][0] for j in chosen}) == len(chosen):
            out.append([move[j] for j in chosen])
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def success(fraction: np.ndarray, sets: list[list[tuple[int, int]]], sigma: float) -> float:
    """Probability that a vector whose projections lie Gaussian, ``sigma`` widths wide, about the query's is in one of the buckets."""
    if sigma == 0:
        return 1.0
    edges = np.stack([-1 - fraction, -fraction, 1 - fraction, 2 - fraction]) / (sigma * math.sqrt(2))
    mass = np.diff(np.vectorize(math.erf)(edges), axis=0) / 2
    row = np.ones((len(sets), len(fraction)), np.int64)
    for j, s in enumerate(sets):
        for f, d in s:
            row[j, f] += d
    return float(mass[row, np.arange(len(fraction))].prod(1).sum())


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 7, probes: int = PROBES, width: float = WIDTH, hashes: int = HASHES, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row that ``is_query`` (a Column) holds for."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    first = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max("asks").alias("asks")).orderBy(F.desc("rows"), "n").first()
    if first is None or not first["asks"]:
        return empty
    dim = first["n"]
    rows = rows.where(F.size("v") == dim)
    kind = dict(rows.dtypes)["v"]
    width *= scale_of(rows, np.array(rows.first()["v"], np.float64), Family(dim, seed, tables, hashes))

    def places(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(dim, seed, tables, hashes, width)
        for batch in frames:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            for t in range(tables):
                cells = np.floor(family.project(x, t))
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(family.keys(cells, t))], names=["id", "v", "bucket"])

    def visits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(dim, seed, tables, hashes, width)
        for batch in frames:
            x = matrix(batch.column("v"))
            for t in range(tables):
                p = family.project(x, t)
                cells = np.floor(p)
                for i in range(len(x)):
                    sets = probe_sets(p[i] - cells[i], probes)
                    moved = np.repeat(cells[i][None], len(sets), 0)
                    for j, s in enumerate(sets):
                        for f, d in s:
                            moved[j, f] += d
                    keys = np.unique(family.keys(moved, t))
                    yield pa.record_batch([pa.array(np.full(len(keys), batch.column("id")[i].as_py(), np.int64)), pa.array(keys)], names=["id", "bucket"])

    posted = cut(rows.select("id", "v").mapInArrow(places, f"id bigint, v {kind}, bucket bigint"), "ann")
    counts = posted.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    stored = posted.join(counts.hint("merge"), "bucket").select("bucket", block.alias("block"), F.lit(1).alias("side"), "id", "v")
    queries = rows.where("asks").select("id", "v")
    asked = queries.repartition(spread_of(vectors), "id").mapInArrow(visits, "id bigint, bucket bigint")
    asked = asked.join(counts.hint("merge"), "bucket").select("id", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.join(queries.hint("merge"), "id").select("bucket", "block", F.lit(0).alias("side"), "id", "v")
    met = asked.unionAll(stored).repartition(spread_of(vectors), "bucket", "block").sortWithinPartitions("bucket", "block", "side")

    def nearest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        at, ids, held, rest = None, [], [], []

        def rank() -> None:
            if not (held and rest):
                return
            q, x = np.concatenate(held), np.concatenate([r[1] for r in rest])
            own, names = np.concatenate(ids), np.concatenate([r[0] for r in rest])
            for i in range(len(q)):
                d = np.sqrt(((x - q[i]) ** 2).sum(1))
                mine, taken = best.setdefault(int(own[i]), {}), set()
                for j in np.lexsort((names, d)):
                    if len(taken) == k:
                        break
                    if names[j] != own[i]:
                        n = int(names[j])
                        taken.add(n)
                        mine[n] = min(float(d[j]), mine.get(n, np.inf))
                if len(mine) > 4 * k:
                    best[int(own[i])] = dict(sorted(mine.items(), key=lambda e: (e[1], e[0]))[:k])

        def told() -> Iterator[pa.RecordBatch]:
            out = [(q, n, d) for q, mine in best.items() for n, d in sorted(mine.items(), key=lambda e: (e[1], e[0]))[:k]]
            best.clear()
            for i in range(0, len(out), 10_000):
                part = out[i : i + 10_000]
                yield pa.record_batch([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in frames:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column("bucket").to_numpy(), batch.column("block").to_numpy().astype(np.int64)], 1)
            side, id_, x = batch.column("side").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"))
            turns = np.flatnonzero(np.any(group[1:] != group[:-1], 1)) + 1
            for a, b in zip([0, *turns], [*turns, len(id_)], strict=True):
                if at != tuple(group[a]):
                    rank()
                    if len(best) > HELD:
                        yield from told()
                    at, ids, held, rest = tuple(group[a]), [], [], []
                asks = side[a:b] == 0
                if asks.any():
                    ids.append(id_[a:b][asks])
                    held.append(x[a:b][asks])
                if not asks.all():
                    rest.append((id_[a:b][~asks], x[a:b][~asks]))
        rank()
        yield from told()

    def ranked(met: DataFrame) -> DataFrame:
        found = met.mapInArrow(nearest, "query_id bigint, vec_id bigint, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def unsure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(dim, seed, tables, hashes, width)
        for batch in frames:
            if not batch.num_rows:
                continue
            x, last = matrix(batch.column("v")), batch.column("last").to_numpy(zero_copy_only=False).astype(np.float64)
            keep = np.isnan(last)
            missed = np.ones(len(x))
            for t in range(tables):
                p = family.project(x, t)
                fraction = p - np.floor(p)
                for i in np.flatnonzero(~keep):
                    missed[i] *= 1 - success(fraction[i], probe_sets(fraction[i], probes), last[i] / math.sqrt(dim) / width)
            yield pa.record_batch([c.filter(pa.array(keep | (missed > 1 - SURE))) for c in (batch.column("id"), batch.column("v"))], names=["id", "v"])

    found = cut(ranked(met), "ann")
    last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
    rest = cut(rows.where("asks").select("id", "v").join(last, "id", "left").repartition(spread_of(vectors), "id").mapInArrow(unsure, f"id bigint, v {kind}"), "ann")
    if rest.isEmpty():
        return found
    blocks = math.ceil(rows.count() / EXACT)
    stored = rows.select(F.lit(0).cast("long").alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "id", "v")
    asked = rest.select(F.lit(0).cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "id", "v")
    met = asked.unionAll(stored).repartition(spread_of(vectors), "bucket", "block").sortWithinPartitions("bucket", "block", "side")
    again = rest.select(F.col("id").alias("query_id")).distinct()
    return found.join(again, "query_id", "left_anti").unionAll(ranked(met))


def scale_of(rows: DataFrame, middle: np.ndarray, family: Family) -> float:
    """Standard deviation of the projections over SPREAD, to two digits, so that the order of a sum changes nothing; 1 if all are alike."""

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v")) - middle
            p = np.concatenate([x @ a for a in family.a], 1)
            yield pa.record_batch([pa.array(np.arange(p.shape[1])), pa.array(np.full(p.shape[1], len(p))), pa.array(p.sum(0)), pa.array((p**2).sum(0))], names=["f", "n", "s", "q"])

    per = rows.select("v").mapInArrow(sums, "f bigint, n bigint, s double, q double").groupBy("f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    variance = sum(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in per) / len(per)
    scale = math.sqrt(max(variance, 0)) / SPREAD
    return float(f"{scale:.1e}") if 0 < scale < math.inf else 1.0

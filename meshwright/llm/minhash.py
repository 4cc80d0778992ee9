"""Near-duplicate classes by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles. COORDINATES minimum hashes make
its signature; the document is posted under each (coordinate, value). Two
documents of similarity 0.75 share MATCHES of these postings or more but for a
chance under one in a million, so it is enough to meet in the prefix: the postings
of each document that are rarest in the corpus, all but MATCHES - 1 of those that
any other document shares. Postings that one document alone has are skipped before
anything meets.

Copies of one word sequence are one node from the start. Then

1. each posting list's least member meets all others of the list, and pairs that
   collide in MATCHES coordinates are confirmed on their full shingle sets; members
   found linked are one component, so that a list of near copies is nearly joined
   at a cost linear in its length;
2. lists that still hold several components are merged inside tasks. A member
   travels once to its list, with its signature; collisions are counted there for
   all pairs of the list, but a pair counts only in the longest list that both
   prefixes share, and only across components. Members of a pair above the
   threshold send their texts to the same place, where the full shingle sets of all
   are intersected at once and a spanning forest of the links comes out. No row is
   made for a pair. A list of more than CELL members, or MASS shingles, is cut into
   blocks that meet two by two.

Step 2 loses no pair: its cost for a list of m members that truly stay apart is
m * m / CELL rows sent and m * m comparisons inside tasks.

Defined cases: a null or empty text, or one without words, has no shingles and is
linked with nothing; a null doc_id is linked with nothing, and its component_id is
null and kept true; rows of one doc_id are one node that has the links of all
their texts (their n_shingles stay their own); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import cut, quoted, spread_of, text_of

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 32, 11
#: Members and shingles of a block of a list; members that one task holds against a list's least one; numbers in a working matrix.
CELL, MASS, STAR, ROOM = 2048, 1_000_000, 4096, 1 << 22
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20_240_601)
FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash, kept for words met before; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(LOWER_BYTES).split()


def shingles(own: list[bytes], memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, own), np.uint64, n)
    if n < SHINGLE:
        return mixed(np.array([int(sum(int(a) * int(b) for a, b in zip(h, PLACES, strict=False)) + n) & (2**64 - 1)], np.uint64))
    total = np.full(n - SHINGLE + 1, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * PLACES[k]
    return np.unique(mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048, None] * FACTORS + TERMS
        low = np.minimum(low, (part ^ (part >> np.uint64(33))).min(0))
    return low.view(np.int64)


def name_of(own: list[bytes]) -> bytes:
    """128 bits that name a word sequence."""
    return hashlib.md5(b" ".join(own)).digest()


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n, name, sig): name tells the word sequence, null without words."""

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in frames:
            n, names, sigs = [], [], []
            for t in batch.column("text"):
                own = words(t.as_py())
                s = shingles(own, memo)
                n.append(len(s))
                names.append(name_of(own) if own else None)
                sigs.append(signature(s) if own else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            flat = pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "n", "name", "sig"])

    return rows_of(docs, key, text).mapInArrow(told, "doc_id bigint, n bigint, name binary, sig array<bigint>")


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(quoted([key])[0]).cast("long").alias("doc_id"), text_of(quoted([text])[0]).alias("text"))


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (a + b - common)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those whose full shingle sets are similar enough.

    The partners of one ``a`` are dealt over blocks of about STAR, each of which gets a's text once.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks"))
    partners = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("b").alias("tid"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("a").alias("tid"))
    rows = partners.unionAll(centres).join(texts, "tid").repartition(spread_of(pairs), "a", "block").sortWithinPartitions("a", "block", "side")

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, centre = WordHashes(), np.empty(0, np.uint64)
        for batch in frames:
            found: tuple[list[int], list[int]] = ([], [])
            for a, side, tid, text in zip(*[batch.column(x).to_pylist() for x in ("a", "side", "tid", "text")], strict=True):
                own = shingles(words(text), memo)
                if side == 0:
                    centre = own
                elif similar(len(np.intersect1d(own, centre, assume_unique=True)), len(own), len(centre)):
                    found[0].append(a)
                    found[1].append(tid)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return rows.mapInArrow(told, "a bigint, b bigint")


def cells(frames: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int, int], list]]:
    """From rows sorted by e, i, j: each (e, i, j) with the values of ``columns``, one list or array for each; a cell may cross batches."""
    at, held = None, [[] for _ in columns]
    for batch in frames:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in "eij"], 1)
        values = [np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) if c == "sig" else batch.column(c).to_pylist() for c in columns]
        turns = np.flatnonzero(np.any(group[1:] != group[:-1], 1)) + 1
        for a, b in zip([0, *turns], [*turns, len(group)], strict=True):
            if at != (now := tuple(group[a].tolist())):
                if at is not None:
                    yield at, [np.concatenate(h) if c == "sig" else [x for p in h for x in p] for c, h in zip(columns, held, strict=True)]
                at, held = now, [[] for _ in columns]
            for h, v in zip(held, values, strict=True):
                h.append(v[a:b])
    if at is not None:
        yield at, [np.concatenate(h) if c == "sig" else [x for p in h for x in p] for c, h in zip(columns, held, strict=True)]


def sides(cell: tuple[int, int, int], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members that a cell holds against each other: all against all in a block, else one block against another."""
    _, i, j = cell
    return np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)


def numbered(values: list) -> np.ndarray:
    names: dict = {}
    return np.array([names.setdefault(v, len(names)) for v in values])


def collide(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts collisions in each cell; gives the members that have a pair above the threshold to confirm there."""
    out: list[list] = [[] for _ in range(6)]

    def told() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["e", "i", "j", "block", "tid", "comp"])
        for c in out:
            c.clear()
        return batch

    for cell, (tid, comp, block, n, over, sig) in cells(frames, ["tid", "comp", "block", "n", "over", "sig"]):
        own, n = numbered(comp), np.array(n)
        longer = (np.array(over, np.int64)[:, None] >> np.arange(COORDINATES)) & 1 == 1
        x, y = sides(cell, np.array(block))
        wanted = np.zeros(len(tid), bool)
        step = max(1, ROOM // max(1, COORDINATES * len(y)))
        for k in range(0, len(x), step):
            part = x[k : k + step]
            same = sig[part][:, None] == sig[y][None]
            pair = (same.sum(2, dtype=np.uint8) >= MATCHES) & (own[part][:, None] != own[y][None])
            pair &= 100 * np.minimum(n[part][:, None], n[y][None]) >= PERCENT * np.maximum(n[part][:, None], n[y][None])
            if pair.any():
                same &= longer[part][:, None] & longer[y][None]
                pair &= ~same.any(2)
                wanted[part] |= pair.any(1)
                wanted[y] |= pair.any(0)
        for r in np.flatnonzero(wanted):
            for c, v in zip(out, (*cell, block[r], tid[r], comp[r]), strict=True):
                c.append(v)
        if len(out[0]) > 10_000:
            yield told()
    yield told()


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in ``a`` with each in ``b``, by products of 0/1 matrices over the values in both sides."""
    flat = [np.concatenate([*s, np.empty(0, np.uint64)]) for s in (a, b)]
    row = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (a, b)]
    names = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, ROOM // max(1, len(a), len(b)))
    for k in range(0, len(names), step):
        some = names[k : k + step]
        ones = []
        for values, r, s in zip(flat, row, (a, b), strict=True):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            m = np.zeros((len(s), len(some)), np.float32)
            m[r[hit], place[hit]] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out.astype(np.int64)


def forest(own: np.ndarray, x: np.ndarray, y: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links enough to join what ``linked``, x by y, joins of the components ``own``."""
    root = np.arange(own.max() + 1 if len(own) else 0)

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for r, c in zip(*np.nonzero(linked), strict=True):
        a, b = find(own[x[r]]), find(own[y[c]])
        if a != b:
            root[max(a, b)] = min(a, b)
            yield x[r], y[c]


def settle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirms each cell's pairs across components on full shingle sets; a forest of the links comes out."""
    memo = WordHashes()
    found: tuple[list[int], list[int]] = ([], [])
    for cell, (tid, comp, block, text) in cells(frames, ["tid", "comp", "block", "text"]):
        own, sets = numbered(comp), [shingles(words(t), memo) for t in text]
        x, y = sides(cell, np.array(block))
        n = np.array([len(s) for s in sets], np.int64)
        common = intersections([sets[k] for k in x], [sets[k] for k in y])
        linked = similar(common, n[x][:, None], n[y][None]) & (own[x][:, None] != own[y][None])
        for a, b in forest(own, x, y, linked):
            found[0].append(tid[a])
            found[1].append(tid[b])
        if len(found[0]) > 10_000:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["a", "b"])
            found = ([], [])
    yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(tid, comp): comp is the least tid that links reach; only linked nodes have rows."""
    edges = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("tid"), F.least("a", "m").alias("comp")), "comp")
    while True:
        near = edges.join(state.withColumnRenamed("tid", "b"), "b").groupBy(F.col("a").alias("tid")).agg(F.min("comp").alias("near"))
        step = state.join(near, "tid").select("tid", "comp", F.least("comp", "near").alias("new"))
        root = state.select(F.col("tid").alias("new"), F.col("comp").alias("root"))
        step = cut(step.join(root, "new", "left").select("tid", F.col("comp").alias("old"), F.least("new", F.coalesce("root", "new")).alias("comp")), "comp")
        state = step.select("tid", "comp")
        if step.where("old <> comp").isEmpty():
            return state


def grown(state: DataFrame, links: DataFrame) -> DataFrame:
    """Components (tid, comp) with more links added: only links between components are followed, not all those of before."""
    ends = [state.select(F.col("tid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    over = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = cut(over.where("a <> b").distinct(), "over")
    if over.isEmpty():
        return state
    new = components(over)
    old = state.join(new.select(F.col("tid").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("tid", F.coalesce("root", "comp").alias("comp"))
    return cut(old.unionAll(new.join(state.select("tid"), "tid", "left_anti")), "state")


def posted(reps: DataFrame) -> DataFrame:
    """(e, tid, over): the posting lists of prefixes. ``over`` has a bit for each coordinate of the prefix whose list is longer."""
    element = F.transform("sig", lambda v, i: F.struct(F.xxhash64(v, i).alias("e"), i.alias("k")))
    all_ = reps.select("tid", F.explode(element).alias("p")).select("tid", "p.e", "p.k")
    shared = all_.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    mine = all_.join(shared, "e").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("df", "e", "k"))).alias("own"))
    mine = mine.where(F.size("own") >= MATCHES).select("tid", F.slice("own", 1, F.size("own") - MATCHES + 1).alias("own"))

    def bits(rest: Column) -> Column:
        return F.aggregate(rest, F.lit(0).cast("long"), lambda acc, p: acc + F.call_function("shiftleft", F.lit(1).cast("long"), p["k"]))

    entry = F.transform("own", lambda p, i: F.struct(p["e"].alias("e"), bits(F.slice("own", i + 2, F.size("own"))).alias("over")))
    return mine.select("tid", F.explode(entry).alias("p")).select("p.e", "tid", "p.over")


def linked(reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """Components (tid, comp) of the confirmed links; None if there are no candidates. ``reps``: tid, name, doc_id, n, sig."""
    lists = cut(posted(reps), "lists")
    if lists.isEmpty():
        return None
    active = cut(reps.join(lists.select("tid").distinct(), "tid"), "active")
    # A doc_id may have rows of other texts; the name tells which row is meant.
    texts = cut(true_texts(rows_of(docs, key, text).join(active.select("tid", "name", "doc_id"), "doc_id")), "texts")

    # First each list's least member meets all others: one of them is enough to join a list of near copies.
    least = lists.groupBy("e").agg(F.min("tid").alias("a"))
    lists = cut(lists.join(least, "e").where("tid <> a"), "lists")
    ends = [active.select(F.col("tid").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
    met = lists.select("a", F.col("tid").alias("b")).distinct().join(ends[0], "a").join(ends[1], "b")
    alike = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    near = met.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).where(alike >= MATCHES)
    state = components(confirm(cut(near.select("a", "b"), "pairs"), texts))

    # Then lists of several components are merged in tasks.
    lists = lists.select("e", "tid", "over").join(state, "tid", "left").select("e", "tid", "over", F.coalesce("comp", "tid").alias("comp"))
    lists = cut(lists.join(active.select("tid", "n"), "tid"), "lists")
    blocks = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / MASS)).cast("int")
    open_ = lists.groupBy("e").agg(blocks.alias("blocks"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("e", "blocks")
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = lists.join(open_, "e").withColumn("block", own).withColumn("other", other)
    dealt = dealt.select("e", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tid", "comp", "over")

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(spread_of(docs), "e", "i", "j").sortWithinPartitions("e", "i", "j")

    met = together(dealt.join(active.select("tid", "n", "sig"), "tid")).mapInArrow(collide, "e bigint, i int, j int, block int, tid bigint, comp bigint")
    return grown(state, together(cut(met, "met").join(texts, "tid")).mapInArrow(settle, "a bigint, b bigint"))


def true_texts(rows: DataFrame) -> DataFrame:
    """Of (doc_id, text, tid, name), one row for each tid, whose text has that name."""

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keep = [name_of(words(t.as_py())) == i for t, i in zip(batch.column("text"), batch.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("text")], names=["tid", "text"]).filter(pa.array(keep, pa.bool_()))

    own = rows.select("tid", "name", "text").mapInArrow(told, "tid bigint, text string")
    return own.groupBy("tid").agg(F.min("text").alias("text"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    seen = cut(sketch(docs, key, text), "sketch")
    named = seen.where(F.col("doc_id").isNotNull() & F.col("name").isNotNull())
    reps = named.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = cut(reps.withColumn("tid", F.monotonically_increasing_id()), "reps")  # fixed once written
    state = linked(reps, docs, key, text)
    # A doc_id with several texts ties them together.
    held = named.select("doc_id", "name").distinct()
    several = held.groupBy("doc_id").agg(F.min("name").alias("least"), F.count("*").alias("names")).where("names > 1").select("doc_id", "least")
    tied = held.join(several, "doc_id").where("name <> least")
    for x, name in (("a", "least"), ("b", "name")):
        tied = tied.join(reps.select(F.col("name").alias(name), F.col("tid").alias(x)), name)
    tied = tied.select("a", "b")
    comp = components(tied) if state is None else grown(state, tied)
    label = reps.select("tid", "name", "doc_id").join(comp, "tid", "left").select("name", F.coalesce("comp", "tid").alias("comp"), "doc_id")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = label.select("name", "comp").join(least, "comp").select("name", "component_id")
    out = seen.select("doc_id", "n", "name").join(label, "name", "left")
    name = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the row of its component_id (of rows that share it, the one of least text hash)."""
    kept = classes(docs, key, text).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(docs.columns))])
    rows = docs.select(F.col(quoted([key])[0]).cast("long").alias("doc_id"), F.xxhash64(text_of(quoted([text])[0])).alias("h"), row.alias("row"))
    one = Window.partitionBy("doc_id").orderBy("h")
    named = rows.join(kept, "doc_id").withColumn("n", F.row_number().over(one)).where("n = 1").select("row")
    left = named.unionAll(rows.where("doc_id IS NULL").select("row"))
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

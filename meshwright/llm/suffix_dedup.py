"""Repeated passages by a sparse enhanced suffix array.

A byte goes when a LENGTH-byte string that covers it also starts in a document of
a smaller id. Any such string holds an anchor: the GRAM-byte string of least hash
among those in it. Only suffixes at anchors are indexed, about one byte in 18.

1. Each anchor is posted under its gram with hashes of its whole context, all the
   bytes that a string of LENGTH bytes around it can reach. Anchors whose whole
   context stands in a smaller document are settled by 96 bits of hash; each map
   task settles its own first and ships one record for a context, so that a
   passage that a third of the corpus shares stays small.
2. Anchors that share a gram, and enough on one side, but not the whole context
   lie near the ends of repeats. Their contexts' bytes meet by gram. There the
   suffixes of the contexts are sorted, neighbours' common prefixes are
   stack-scanned into an interval tree, and an interval of LENGTH bytes or more
   whose members differ in the byte before (left-diverse) is a maximal repeat with
   all its occurrences; those outside its least document are covered. A gram with
   more than SPLIT contexts is split by more bytes: a string of LENGTH bytes has the
   gram at a place STEP * i + 0 to STEP - 1, and so holds one of a few longer strings
   around it; contexts meet by each of those that they have, and the same scan runs.
3. Covered stretches of a document are merged and cut from its bytes.

Unlike contexts that share all but STEP bytes of a string of LENGTH meet in one task;
its suffixes are sorted for one leading byte at a time.

Defined cases: a null text is empty; a text under LENGTH bytes loses nothing; a
null doc_id neither loses bytes nor makes others lose them; rows of one doc_id
don't act on each other, whatever their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import cut, spread_of, text_of
from meshwright.llm.minhash import mixed

LENGTH, GRAM = 50, 16
SIDE = LENGTH - GRAM
HALF = SIDE // 2
SPLIT, STEP = 10_000, 4
FLUSH = 2 << 20
BUCKET, PARTITION = 2 << 20, 16 << 20
_rng = np.random.default_rng(97)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
CHUNK, PARTS = 1 << 18, 1 << 17
SMALL = np.uint64((1 << 48) - 1)


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64."""

    def __init__(self, n: int) -> None:
        self.up, self.down = (np.ones(n + 1, np.uint64) for _ in range(2))  # unsigned throughout: a mixed array would turn to floats
        self.up[1:], self.down[1:] = BASE, pow(BASE, -1, 2**64)
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values, by doubling."""
    m, s = a, 1
    while 2 * s <= w:
        m, s = f(m[:-s], m[s:]), 2 * s
    n = len(a) - w + 1
    return f(m[:n], m[w - s : w - s + n])


def anchors(b: bytes, powers: Powers):
    """Positions of anchors, gram hashes, context hashes, bytes of context left and right, hashes of half a side each."""
    n = len(b)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[np.frombuffer(b, np.uint8)] * powers.up[:n], out=h[1:])
    grams = mixed((h[GRAM:] - h[:-GRAM]) * powers.down[: n - GRAM + 1])
    least = sliding(grams, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    p = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum) == grams)

    def between(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((h[e] - h[s]) * powers.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    s, e = np.maximum(p - SIDE, 0), np.minimum(p + LENGTH, n)
    left, right = p - s, e - p
    whole = between(s, e) ^ mixed(left.astype(np.uint64))
    # A half that is cut short by an end of the text can't be shared in full; 0 marks it.
    lh = np.where(left >= HALF, (between(p - np.minimum(left, HALF), p) & np.uint64(0xFF)) | np.uint64(1), 0)
    rh = np.where(right >= GRAM + HALF, (between(p, p + np.minimum(right, GRAM + HALF)) & np.uint64(0xFF)) | np.uint64(1), 0)
    return p, grams[p] & SMALL, whole & SMALL, left, right, lh.astype(np.uint8), rh.astype(np.uint8)


COLUMNS = ("kh", "ch", "doc", "tag", "pos", "left", "right", "lh", "rh")


def width(buckets: int) -> int:
    """Bytes of a gram hash of 48 bits whose remainder by the number of buckets is known."""
    return -(-(int(SMALL) // buckets).bit_length() // 8)


def pack(c: dict[str, np.ndarray], buckets: int) -> bytes:
    """Columns of one bucket's records in order of doc and pos: hashes as they are, the rest as compressed differences."""
    order = np.lexsort((c["pos"], c["doc"]))
    c = {k: v[order] for k, v in c.items()}
    hashes = ((c["kh"] // np.uint64(buckets), width(buckets)), (c["ch"], 6))
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :w].tobytes() for x, w in hashes) + c["lh"].tobytes() + c["rh"].tobytes()
    doc = np.diff(c["doc"], prepend=0).astype("<i8")
    rest = zlib.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(doc), -1).T).tobytes() for x in (doc, c["tag"].astype("<i4"), c["pos"].astype("<i4"))) + c["left"].astype(np.uint8).tobytes() + c["right"].astype(np.uint8).tobytes(), 1)
    return len(order).to_bytes(4, "little") + raw + rest


def unpack(b: bytes, bucket: int, buckets: int) -> dict[str, np.ndarray]:
    n, at = int.from_bytes(b[:4], "little"), 4
    out = {}
    for k, w in (("kh", width(buckets)), ("ch", 6)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(b, np.uint8, w * n, at).reshape(n, w)
        out[k] = wide.reshape(-1).view(np.uint64)
        at += w * n
    out["kh"] = out["kh"] * np.uint64(buckets) + np.uint64(bucket)
    out["lh"], out["rh"] = np.frombuffer(b, np.uint8, n, at), np.frombuffer(b, np.uint8, n, at + n)
    rest = np.frombuffer(zlib.decompress(b[at + 2 * n :]), np.uint8)
    at = 0
    for k, size in (("doc", 8), ("tag", 4), ("pos", 4)):
        out[k] = np.ascontiguousarray(rest[at : at + size * n].reshape(size, n).T).reshape(-1).view(f"<i{size}")
        at += size * n
    out["doc"] = np.cumsum(out["doc"])
    out["left"], out["right"] = rest[at : at + n], rest[at + n : at + 2 * n]
    return out


def settle(c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A mask of the records whose whole context stands in a smaller document of these; the records sorted by gram, context, document."""
    order = np.lexsort((c["doc"], c["ch"], c["kh"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["kh"][1:] != c["kh"][:-1]) | (c["ch"][1:] != c["ch"][:-1])
    first = c["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else c["doc"]
    return c["doc"] > first, c


STRETCH = ("doc", "tag", "start", "end")


def stretches(doc, tag, start, end) -> bytes:
    """Packed, with stretches of a document that overlap joined (all end in the order in which they start)."""
    c = np.stack([np.asarray(x, np.int64) for x in (doc, tag, start, end)])
    c = c[:, np.lexsort((c[2], c[1], c[0]))]
    new = np.ones(c.shape[1], bool)
    new[1:] = np.any(c[:2, 1:] != c[:2, :-1], 0) | (c[2, 1:] > c[3, :-1])
    first = np.flatnonzero(new)
    out = c[:, first].copy()
    out[3] = c[3, np.append(first[1:], c.shape[1]) - 1]
    return out.tobytes()


def post(buckets: int):
    """Map task: (bucket, kind, blob); kind 0 records of anchors, kind 1 stretches settled here."""

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(CHUNK)
        parts, size, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, turn
            if not parts:
                return
            c = {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(COLUMNS)}
            parts, size, turn = [], 0, turn + 1
            gone, c = settle(c)
            b = (c["kh"] % np.uint64(buckets)).astype(np.int64)
            rows: list[tuple[int, int, bytes]] = []
            if gone.any():
                start = c["pos"][gone] - c["left"][gone]
                rows.append((int(c["kh"][0]) % buckets, 1, stretches(c["doc"][gone], c["tag"][gone], start, c["pos"][gone].astype(np.int64) + c["right"][gone])))
            stay = np.flatnonzero(~gone)
            stay = stay[np.argsort(b[stay], kind="stable")]
            edges = np.flatnonzero(np.diff(b[stay])) + 1
            for own in np.split(stay, edges):
                if len(own):
                    rows.append((int(b[own[0]]), 0, pack({k: v[own] for k, v in c.items()}, buckets)))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

        for batch in frames:
            for doc, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode("utf-8")
                step = CHUNK - 4 * LENGTH
                for at in range(0, max(1, len(raw)), step):  # a long text in overlapping parts; anchors near an inner end are left to the next part
                    piece = raw[at : at + CHUNK]
                    if len(piece) < LENGTH:
                        continue
                    p, kh, ch, left, right, lh, rh = anchors(piece, powers)
                    inner = (p >= (2 * LENGTH if at else 0)) & ((p < step + 2 * LENGTH) | (at + CHUNK >= len(raw)))
                    n = int(inner.sum())
                    parts.append((kh[inner], ch[inner], np.full(n, doc, np.int64), np.full(n, tag, np.int32), (p[inner] + at).astype(np.int32), left[inner].astype(np.int64), right[inner].astype(np.int64), lh[inner], rh[inner]))
                    size += len(piece)
                    if size >= FLUSH:
                        yield from flush()
                    if at + CHUNK >= len(raw):
                        break
        yield from flush()

    return told


FOUND = "doc_id bigint, tag int, what int, a bigint, b bigint, kh bigint, left int"


def rows_of(what: int, doc, tag, a, b, kh=None, left=None) -> pa.RecordBatch:
    n = len(doc)
    kh, left = (np.zeros(n, np.int64) if x is None else x for x in (kh, left))
    return pa.record_batch([pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(tag, np.int32)), pa.array(np.full(n, what, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(kh, np.int64)), pa.array(np.asarray(left, np.int32))], names=["doc_id", "tag", "what", "a", "b", "kh", "left"])


def meet(frames: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Reduce task, bucket by bucket: covered stretches (what 0) and anchors whose contexts must be compared (what 1)."""
    at, blobs = 0, []

    def done() -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        many = [unpack(b, at, buckets) for b in blobs]
        gone, c = settle({k: np.concatenate([m[k] for m in many]) for k in COLUMNS})
        if gone.any():
            yield rows_of(0, c["doc"][gone], c["tag"][gone], c["pos"][gone].astype(np.int64) - c["left"][gone], c["pos"][gone].astype(np.int64) + c["right"][gone])
        c = {k: v[~gone] for k, v in c.items()}
        kh = c["kh"]
        unlike = np.zeros(len(kh), bool)
        for half in ("lh", "rh"):  # some other document and context has the same half
            order = np.lexsort((c["ch"], c["doc"], c[half], kh))
            k, x, d, w = kh[order], c[half][order], c["doc"][order], c["ch"][order]
            new = np.ones(len(order), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
            begin = np.flatnonzero(new)
            if len(begin):
                last = np.append(begin[1:], len(order)) - 1
                mixed_docs = (d[begin] != d[last])[np.cumsum(new) - 1] & (x != 0)
                unlike[order[mixed_docs]] = True
        if unlike.any():
            pos = c["pos"][unlike].astype(np.int64)
            yield rows_of(1, c["doc"][unlike], c["tag"][unlike], pos - c["left"][unlike], pos + c["right"][unlike], kh[unlike].astype(np.int64), c["left"][unlike])

    for batch in frames:
        for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if kind == 1:
                doc, tag, start, end = np.frombuffer(blob.as_py(), np.int64).reshape(4, -1)
                yield rows_of(0, doc, tag, start, end)
                continue
            if bucket != at:
                yield from done()
                at, blobs = bucket, []
            blobs.append(blob.as_py())
    yield from done()


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    unlike = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (unlike.bit_length() + 7) // 8


def maximal_repeats(texts: list[bytes], least: int = LENGTH, starts: list[range] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences (text, place)) of each maximal repeat of ``least`` bytes or more among the suffixes (all, or those at ``starts``).

    An enhanced suffix array of the texts' suffixes: sorted suffixes, common prefixes of neighbours, and a stack
    scan of the common-prefix interval tree, in which an interval closes when a lower common prefix comes. Of its
    members the bytes before are compared; an interval whose members all have the same one is no maximal repeat.
    A suffix at a text's start has no byte before and differs from any.
    """
    starts = [range(len(t) - least + 1) for t in texts] if starts is None else starts
    # No common prefix crosses leading bytes, so many suffixes are sorted in parts.
    many = sum(map(len, starts)) > PARTS
    for lead in sorted({t[s] for t, own in zip(texts, starts, strict=True) for s in own}) if many else [None]:
        yield from intervals(sorted((t[s:], i, s) for i, (t, own) in enumerate(zip(texts, starts, strict=True)) for s in own if lead is None or t[s] == lead), texts, least)


def intervals(suffixes: list[tuple[bytes, int, int]], texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The stack scan over sorted suffixes."""
    before = [texts[i][s - 1] if s else -1 - i for _, i, s in suffixes]
    stack: list[tuple[int, int]] = []  # (common prefix, first member)
    for r in range(1, len(suffixes) + 1):
        # A common prefix under ``least`` closes all intervals, whatever its length.
        lcp = common(suffixes[r - 1][0], suffixes[r][0]) if r < len(suffixes) and suffixes[r - 1][0][:least] == suffixes[r][0][:least] else 0
        begin = r - 1
        while stack and stack[-1][0] > lcp:
            length, begin = stack.pop()
            if length >= least and any(before[j] != before[begin] for j in range(begin + 1, r)):
                yield length, [(suffixes[j][1], suffixes[j][2]) for j in range(begin, r)]
        if lcp >= least and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, begin))


def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key: stretches that the maximal repeats of each key's contexts cover."""
    at, group = None, []
    out: list[tuple[int, int, int, int]] = []

    def done() -> None:
        if len(group) < 2:
            return
        n, part = len(group), at[1]
        reach: list[list[int]] = []
        for side in (lambda g: g[4][g[3] :], lambda g: g[4][: g[3]][::-1]):  # right of the anchor's start; left of it, backward
            keyed = sorted((side(g), i) for i, g in enumerate(group))
            best = [0] * n
            for (x, i), (y, j) in zip(keyed, keyed[1:], strict=False):
                c = common(x, y)
                best[i], best[j] = max(best[i], c), max(best[j], c)
            reach.append(best)
        # No other context agrees with one beyond its reach, so that only the stretch within it is indexed.
        near = [(doc, tag, start + left - lt, text[left - lt : left + rt], lt) for (doc, tag, start, left, text), rt, lt in zip(group, *reach, strict=True) if rt + lt >= LENGTH]
        if len({g[0] for g in near}) < 2:
            return
        texts = [g[3] for g in near]
        # Of a split gram, each key answers for the strings that have the gram at its STEP places.
        starts = None if part < 0 else [range(max(0, g[4] - part - STEP + 1), min(g[4] - part, len(g[3]) - LENGTH) + 1) for g in near]
        docs = [g[0] for g in near]
        ends: list[dict[int, int]] = [{} for _ in near]  # of each text, the farthest end of a repeat by its start
        for length, places in maximal_repeats(texts, LENGTH, starts):
            least = min(docs[i] for i, _ in places)
            for i, s in places:
                if docs[i] > least and ends[i].get(s, 0) < s + length:
                    ends[i][s] = s + length
        for (doc, tag, start, *_), spans in zip(near, ends, strict=True):
            since = until = -1
            for s, e in sorted(spans.items()):
                if s > until:
                    if until > 0:
                        out.append((doc, tag, start + since, start + until))
                    since = s
                until = max(until, e)
            if until > 0:
                out.append((doc, tag, start + since, start + until))

    def told() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return rows_of(0, *cols)

    for batch in frames:
        for kh, part, doc, tag, start, left, text in zip(*[batch.column(k).to_pylist() for k in ("kh", "part", "doc_id", "tag", "start", "left", "context")], strict=True):
            if (kh, part) != at:
                done()
                at, group = (kh, part), []
                if len(out) > 10_000:
                    yield told()
            group.append((doc, tag, start, left, text))
    done()
    if out:
        yield told()


def merged(spans: pa.ListArray) -> list[list[tuple[int, int]]]:
    """For each row, its spans (a, b) in order, with those that overlap or touch joined."""
    flat, counts = spans.flatten(), spans.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts)
    a, b = (row + flat.field(i).to_numpy() for i in range(2))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    a, b = a[first], b[np.append(first[1:], len(b)) - 1] if len(b) else b
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    for r, x, y in zip((a >> 32).tolist(), (a & 0xFFFFFFFF).tolist(), (b & 0xFFFFFFFF).tolist(), strict=True):
        out[r].append((x, y))
    return out


def identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, tag, text), and the columns that name a text; tag tells the texts of a repeated doc_id apart and is 0 for all others."""
    # No alias where none is needed: the two uses of these rows would differ by it, and the exchange not be used again.
    name = F.col(key) if key == "doc_id" and dict(docs.dtypes).get(key) == "bigint" else F.col(f"`{key}`").cast("long").alias("doc_id")
    rows = docs.select(name, text_of(f"`{text}`").alias("text"))
    again = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return rows.withColumn("tag", F.lit(0)), ["doc_id"]
    mark = F.when(F.col("again"), F.hash("text")).otherwise(0)
    return rows.join(again, "doc_id", "left").select("doc_id", "text", mark.alias("tag")), ["doc_id", "tag"]


def concerned() -> Column:
    """Whether a row can lose bytes or make others lose them."""
    return F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)


def covered(named: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, tag, a, b): stretches of bytes to remove. ``named``: doc_id, tag, text, of rows that ``concerned`` holds for; ``keys`` name a text."""
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spread_of(named), -(-size // PARTITION))
    buckets = max(parts, -(-size // BUCKET))
    posted = named.mapInArrow(post(buckets), "bucket int, kind int, blob binary")
    found = cut(posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda frames: meet(frames, buckets), FOUND), "anchors")
    unlike = found.where("what = 1")
    crowded = unlike.groupBy("kh").count().where(F.col("count") > SPLIT).select("kh", F.lit(True).alias("crowded"))
    asked = unlike.join(crowded, "kh", "left").groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "kh", "left", "crowded")).alias("asked"))
    raw = F.encode("text", "UTF-8")
    held = named.join(asked, keys).select("doc_id", "tag", raw.alias("raw"), F.explode("asked").alias("q"))
    held = held.select("q.kh", "q.crowded", "doc_id", "tag", F.col("q.a").alias("start"), "q.left", F.substring("raw", (F.col("q.a") + 1).cast("int"), (F.col("q.b") - F.col("q.a")).cast("int")).alias("context"))
    whole = F.array(F.struct("kh", F.lit(-1).alias("part")))
    held = held.withColumn("key", F.explode(F.when(F.col("crowded"), longer_keys()).otherwise(whole))).select("key.*", "doc_id", "tag", "start", "left", "context")
    repeats = held.repartition(parts, "kh", "part").sortWithinPartitions("kh", "part").mapInArrow(compare, FOUND)
    columns = ["doc_id", "tag", "a", "b"]
    return found.where("what = 0").select(*columns).unionAll(repeats.select(*columns))


def longer_keys() -> Column:
    """Of a context, (hash, place) of the strings around its gram one of which any string of LENGTH bytes through the gram holds."""
    keys = []
    for left in range(0, SIDE + 1, STEP):
        right = GRAM + max(0, SIDE - left - (STEP - 1))
        there = (F.col("left") >= left) & (F.length("context") - F.col("left") >= right)
        key = F.xxhash64("kh", F.substring("context", F.col("left") - left + 1, F.lit(left + right)))
        keys.append(F.when(there, F.struct(key.alias("kh"), F.lit(left).alias("part"))))
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``."""
    rows, keys = identified(docs, key, text)
    named = rows.where(concerned()).select("doc_id", "tag", "text")
    spans = covered(named, keys).groupBy(*keys).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = []
            for t, gaps in zip(batch.column("text"), merged(batch.column("spans")), strict=True):
                raw, at, kept = t.as_py().encode("utf-8"), 0, hashlib.sha256()
                for a, b in gaps:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in gaps), len(gaps), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    # The same frame as in the join for contexts, so that texts are shuffled once and that exchange is used again.
    cut_ = named.join(spans, keys, "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    whole = rows.where(~concerned()).select("doc_id", "text", none.alias("spans"))
    return cut_.unionAll(whole).mapInArrow(told, schema)

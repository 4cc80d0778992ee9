"""The training-data operators against brute force, on small tables and on awkward rows."""

import base64
import hashlib
import re
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("meshwright.llm.queries")
from meshwright.llm import ann, bpe, chat, minhash, mixing, pii, quality, suffix_dedup, toxicity, url_filter  # noqa: E402
from meshwright.llm import queries as q  # noqa: E402

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, rule string, __spans2 int"
AWKWARD = [
    (1, None, "en", "a", None, "x", None, 1),
    (2, "", "en", "a", 0, "x", None, 1),
    (3, " \t\n\x0b\x0c\r", "en", None, 0, "x", None, 1),
    (4, "one two three", "en", None, 0, "x", None, 1),
    (5, "ONE two\nthree", "en", "b", 0, "x", None, 1),
    (5, "ONE two\nthree", "en", "b", 0, "x", None, 1),
    (6, "a b c d e f g h i j " * 30, None, "b", 0, "x", None, 1),
    (7, "a b c d e f g h i j " * 30 + "k", None, "c", 0, "x", None, 1),
    (7, "other words here that make a second text of this very same document id, with enough bytes", None, "c", 0, "x", None, 1),
    (8, "héllo \U0001f600 wörld " * 900, "de", "ü", 0, "x", None, 1),
    (None, "no id but words of some kind in a row", "de", "ü", 0, "x", None, 1),
    (9, "mail a@b.c_d@e.f, ..x@y.z.w 300.1.1.1 1.2.3.4.5 +1 (555) 010-9999 4111 1111 1111 1111 4111111111111112 DE89 3704 0044 0532 0130 00 iban", "de", "c", 0, "x", None, 1),
    (10, "x" * 5000 + "@" + "y." * 3000 + "z" + " 1" * 4000 + "+" * 3000, "de", "c", 0, "x", None, 1),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(AWKWARD, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


def texts(spark, d):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, empty, name):
    rows = q.queries()[name](spark, empty).collect()
    assert len(rows) == (name == "op9_chat")  # the planted conversation


@pytest.mark.parametrize("d", [SMALL, "awkward"])
def test_mixing(spark, d, request):
    d = request.getfixturevalue("awkward") if d == "awkward" else d
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows = q.op1_mixing(spark, d).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"]))) for r in docs)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    by = {r["doc_id"]: r["source"] for r in docs}
    taken = defaultdict(int)
    for r in rows:
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1.01 for s in taken)
    again = q.op1_mixing(spark, d).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    places = [r["position"] for r in rows if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_mix_cuts_one_copy_a_source(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    whole = {(r["doc_id"], r["text"]) for r in docs.collect()}
    rows = out.collect()
    part = [r for r in rows if (r["doc_id"], r["text"]) not in whole]
    assert len(part) <= docs.select("source").distinct().count()
    taken = {r["doc_id"]: r["taken"] for r in q.op1_mixing(spark, SMALL).collect()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += len(words(r["text"]))
    assert all(got[i] == n for i, n in taken.items())


def test_schedule_inverts():
    for knots in mixing.SCHEDULES:
        s = mixing.integrate(knots)
        area = s[-1]["before"] + (1 - s[-1]["t"]) * s[-1]["rate"] + (1 - s[-1]["t"]) ** 2 * s[-1]["slope"] / 2
        assert abs(area - 1) < 1e-12


def url_brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    more = [None, "", "no scheme", "://", "HTTP://A.Example.NET/en/x", "http://net/", "http://net", "http://xnet/", "http://a.org/fr/?q=://b.net/", "http://a.org/FR/", "x://example.com/de/1#y", "http://..net//", "a\nb://q.net/z", "http://ünï.net/é"]
    rows = [tuple(r) for r in rows] + [(-i, u) for i, u in enumerate(more)] * 2 + [(None, "http://a.net/")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_filter.judge(frame, url_filter.rules_frame(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((i, *url_brute(u)) for i, u in rows)
    assert {r["verdict"] for r in url_filter.judge(frame, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_toxicity_held_out(spark):
    rows = q.op3_toxicity(spark, MID).alias("a").join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum((r["predicted"] == 1) == (r["toxic"] == 1) for r in rows)
    assert right / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_awkward(spark, awkward):
    rows = q.op3_toxicity(spark, awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] is not None for r in rows)


def test_segments_are_maximal():
    import random

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(1, n)))
        scores = [rng.choice([0.2, 0.5, 1.1]) for _ in at]
        full = [-0.3] * n
        for i, s in zip(at, scores):
            full[i] = s

        def split(a, b):  # the definition: the best segment, then left and right of it
            best = max(((round(sum(full[i:j]), 9), j - i, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 1e-12 else [*split(a, best[3]), best[3:], *split(best[4], b)]

        got = sorted(round(s, 9) for *_, s in toxicity.segments(at, scores))
        want = sorted(round(sum(full[i:j]), 9) for i, j in split(0, n))
        assert got == want


def shingle_set(t):
    own = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in words(t)]
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def near_brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    distinct = {}
    for i, s in sets:
        if i is not None and s:
            j = distinct.setdefault((s), i)
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    by = defaultdict(list)
    for k, s in enumerate(distinct):
        for x in s:
            by[x].append(k)
    keys = list(distinct)
    meet = Counter()
    for own in by.values():
        for x in range(len(own)):
            for y in range(x):
                meet[own[y], own[x]] += 1
    for (x, y), n in meet.items():
        if 100 * n >= 75 * (len(keys[x]) + len(keys[y]) - n):
            a, b = root(distinct[keys[x]]), root(distinct[keys[y]])
            up[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else root(i) if s else i, True if i is None else (root(i) if s else i) == i) for i, s in sets)


def test_near_duplicates(spark, awkward):
    for d in (awkward, SMALL, MID):
        got = Counter(map(tuple, q.op4_minhash(spark, d).collect()))
        assert got == near_brute(texts(spark, d)), d


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):  # near copies of one text, some of them only linked through others
        own = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6])):
            own[k] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{rng.randint(0, 10**6)}" for _ in range(60)])) for i in range(60)]
    frame, want = spark.createDataFrame(rows, "doc_id bigint, text string"), near_brute(rows)
    assert Counter(map(tuple, minhash.classes(frame).collect())) == want
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "STAR", 8)
    assert Counter(map(tuple, minhash.classes(frame).collect())) == want


def test_intersections(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.intersections(a, b).tolist() == want
    monkeypatch.setattr(minhash, "ROOM", 20)
    assert minhash.intersections(a, b).tolist() == want


def test_dedup_keeps_one(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 6, 8, 9, 10] and ids.count(None) == 1


def quality_brute(t):
    own = words(t)
    at = defaultdict(list)
    for i in range(len(own) - 4):
        at[tuple(own[i : i + 5])].append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("d", [MID, "awkward"])
def test_quality(spark, d, request):
    d = request.getfixturevalue("awkward") if d == "awkward" else d
    rows = q.op5_quality(spark, d).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((i, *quality_brute(t)) for i, t in texts(spark, d))
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark):
    rows = q.op5_quality(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] is not None and r[-2] == 1]
    assert sum(good) / len(good) >= 0.97


def repeats_brute(rows, n=50):
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - n + 1):
                w = b[k : k + n]
                least[w] = min(least.get(w, i), i)
    out = Counter()
    for i, b in raw:
        mask = bytearray(len(b))
        for k in range(len(b) - n + 1) if i is not None else ():
            if least[b[k : k + n]] < i:
                mask[k : k + n] = b"\x01" * n
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out[i, len(b), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(spark, awkward, monkeypatch):
    for d in (awkward, SMALL):
        assert Counter(map(tuple, q.op6_suffix_dedup(spark, d).collect())) == repeats_brute(texts(spark, d)), d
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2)
    assert Counter(map(tuple, q.op6_suffix_dedup(spark, SMALL).collect())) == repeats_brute(texts(spark, SMALL))


def test_repeats_at_odd_places(spark):
    import random

    rng = random.Random(11)
    parts = ["".join(rng.choice("abcd") for _ in range(rng.randint(20, 130))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 9) :] + rng.choice(["", "Q", "é"]) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    got = Counter(map(tuple, suffix_dedup.removed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == repeats_brute(rows)


@pytest.mark.parametrize("parts", [2, 1 << 17])
def test_maximal_repeats(monkeypatch, parts):
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    got = {(n, tuple(sorted(o))) for n, o in suffix_dedup.maximal_repeats([b"xabcdefy", b"zabcdefw", b"qbcdeq"], 3)}
    assert got == {(6, ((0, 1), (1, 1))), (4, ((0, 2), (1, 2), (2, 1)))}


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    import random

    rng = random.Random(4)

    def noise():
        return "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))

    for n in (47, 49, 50, 51, 90):
        passage = "".join(rng.choice("ijklmnop ") for _ in range(n))
        rows = [(i, noise() + passage + noise()) for i in range(300)]
        frame, want = spark.createDataFrame(rows, "doc_id bigint, text string"), repeats_brute(rows)
        for split in (20, 2000):
            monkeypatch.setattr(suffix_dedup, "SPLIT", split)
            assert Counter(map(tuple, suffix_dedup.removed(frame).collect())) == want, (n, split)


def test_bpe(spark, awkward):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(q.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in (SMALL, awkward):
        want = Counter()
        for i, t in texts(spark, d):
            ids = e.encode_ordinary(t or "")
            want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, q.op7_bpe(spark, d).collect())) == want
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    coded = bpe.decode(bpe.encode(docs, P.path(q.VOCABULARY), P.PATTERN), P.path(q.VOCABULARY), P.PATTERN)
    assert all(bytes(r["__bytes"]).decode() == (r["text"] or "") for r in coded.collect())


def test_bpe_holds_little(spark):
    """A worker's memory: results leave by slices, not by batches, and the tables of pre-tokens are small."""
    import public_tokenizers as P
    import pyarrow as pa
    import tiktoken

    ranks = bpe.ranks_of(P.path(q.VOCABULARY))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, P.PATTERN)
    long = ["", "ab c" * 30_000, "a", "", "\u4e2d\u6587 x" * 9_000, "b c"] * 8
    read = []

    def parts():
        for batch in (pa.array(long), pa.array([], pa.string()), pa.array(["d", ""])):
            read.append(len(batch))
            yield batch

    out = bpe.told(c, parts(), True)
    first = next(out)
    assert read == [len(long)] and len(first) < len(long)
    got = [first, *out]
    assert all(sum(x["n_tokens"] for x in a.to_pylist()[:-1]) < bpe.SLICE for a in got) and len(got) > 3
    rows = [x for a in got for x in a.to_pylist()]
    assert [x["ids"] for x in rows] == [e.encode_ordinary(t) for t in [*long, "d", ""]]
    assert [x["n_tokens"] for x in rows] == [len(x["ids"]) for x in rows]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*long, None, "e f g h i j k"])], "doc_id bigint, text string").coalesce(1)
    for r in bpe.digests(frame, P.path(q.VOCABULARY), P.PATTERN, with_ids=True).collect():
        ids = e.encode_ordinary(r["text"] or "")
        assert (list(r["ids"]), r["n_tokens"]) == (ids, len(ids)) and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.digests(frame.where("doc_id < 0"), P.path(q.VOCABULARY), P.PATTERN, with_ids=True).collect() == []

    for i in range(1000, 461_000, 1000):
        c.encode(" ".join(f"{n:x}" for n in range(i, i + 1000)).translate(str.maketrans("0123456789", "ghijklmnop")))
    tables = (c.memo, c.older)
    assert sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) + 16 for k, v in t.items()) for t in tables) < 70e6


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(999)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(999))


def near_vectors(rows, k=10):
    import numpy as np

    x = np.stack([v for _, v in rows]).astype(float)
    ids = np.array([i for i, _ in rows])
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - np.asarray(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            yield i, [(int(ids[j]), float(d[j])) for j in order]


@pytest.mark.parametrize("d", [SMALL, MID, "/root/testdata/sf0.1"])
def test_neighbours(spark, d):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in sorted(q.op8_ann(spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for i, want in near_vectors(rows):
        exact = dict(want)
        hits += len({n for n, _ in got[i]} & set(exact))
        total += len(want)
        assert all(abs(exact.get(n, s) - s) < 1e-12 for n, s in got[i]) and got[i] == sorted(got[i], key=lambda e: (e[1], e[0]))
    assert hits / total >= 0.9


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (100, [0.9, 0.1]), (None, [1.0, 1.0]), (200, None), (8, [1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank string")
    got = ann.search(frame, F.col("vec_id") % 100 == 0, probes=400).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 100]


def recall(spark, rows, more=()):
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in [*rows, *more]], "vec_id bigint, embedding array<double>")
    got = defaultdict(dict)
    for r in ann.search(frame, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    out = {}
    for i, want in near_vectors(rows):
        assert len(got[i]) == len(want)
        out[i] = len(set(got[i]) & {n for n, _ in want}) / len(want)
    return out


@pytest.mark.parametrize("times", [0.01, 2, 5, 1000])
def test_neighbours_at_any_scale(spark, times):
    rows = [(r["vec_id"], [times * c for c in r["embedding"]]) for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()]
    found = recall(spark, rows).values()
    assert sum(found) / len(found) >= 0.9


def test_neighbours_in_clusters(spark):
    import random

    rng = random.Random(6)
    seen = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()]
    centres = [[rng.gauss(0, 1) for _ in seen[0][1]] for _ in range(12)]
    rows = [(i, [a + 0.05 * b for a, b in zip(centres[rng.randrange(12)], v)]) for i, v in seen]
    found = recall(spark, rows).values()
    assert sum(found) / len(found) >= 0.9


def test_neighbours_of_a_long_query(spark):
    rows = [(r["vec_id"], [(4 if r["vec_id"] == 100 else 1) * c for c in r["embedding"]]) for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()]
    assert recall(spark, rows)[100] == 1


def test_a_query_of_another_length(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(0, 300, 50)]
    frame = spark.createDataFrame([*rows, (400, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = {r["query_id"] for r in ann.search(frame, F.col("vec_id") % 100 == 0).collect()}
    assert got == {0, 100, 200}


def test_neighbours_in_small_tables(spark):
    rows = [(100 * i, r["embedding"]) for i, r in enumerate(spark.read.parquet(f"{MID}/embeddings.parquet").orderBy("vec_id").limit(8).collect())]
    assert set(recall(spark, rows).values()) == {1}
    assert set(recall(spark, rows, more=[rows[1]] * 15).values()) == {1}


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 1, "assistant", "<|end|> \\l <"), (-1, 0, "us|er", None), (-1, 0, None, "|>"), (None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (-2, None, "assistant", "<|turn:assistant|>\\")]
    got = {r["conv_id"]: r for r in chat.format_frame(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), want, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_parts():
    v = chat.format_conversation([("user", [{"type": "image", "ref": "s3://a", "units": 2}, {"type": "text", "text": "see <|image:0|>"}, {"type": "audio", "ref": "b", "units": 3}]), ("assistant", [{"type": "text", "text": "ok"}])])
    assert [(a["type"], a["ref"], a["tokens"]) for a in v.attachments] == [("image", "s3://a", 425), ("audio", "b", 75)]
    assert all(v.text[a["offset"] :].startswith(f"<|{a['type']}:{a['index']}|>") for a in v.attachments)
    assert chat.read_back(v.text) == [("user", "see <|image:0|>", [0, 1]), ("assistant", "ok", [])]


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(re.sub(r"\D", "", x)) <= 19 and luhn(x)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub(r"\D", "", x)) <= 15),
}


def pii_brute(t):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in BASE.items()}


@pytest.mark.parametrize("d", [MID, "awkward"])
def test_pii(spark, d, request):
    d = request.getfixturevalue("awkward") if d == "awkward" else d
    want = Counter()
    for i, t in texts(spark, d):
        s = pii_brute((t or "")[:5000] + (t or "")[5000:])
        want[i, *(len(s[k]) for k in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE for a, b in s[k]).encode()).hexdigest()] += 1
    rows = q.op10_pii(spark, d).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == want
    for r in rows:
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
    if d != MID:
        assert any("iban:" in r["spans"] for r in rows)


def test_ip_parts(spark):
    said = ["1192.168.1.1", "on 2024.10.1.2, 2024.10.1.300", "0001.0.0.0 and 1.2.3.0000", "000255.1.1.1 000256.1.1.1", "1.1000.1.1 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")
    for r in pii.find(docs).collect():
        assert [(s["start"], s["end"]) for s in r["__spans"] if s["kind"] == "ip"] == pii_brute(r["text"])["ip"]


def test_context_before_a_list(spark):
    docs = spark.createDataFrame([(1, "SSN: 123-45-6789, 987-65-4320"), (2, "SSN: 123-45-6789, " + "x" * 40 + " 987-65-4320"), (3, "é ssn 123-45-6789")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {1: "SSN: [SSN], [SSN]", 2: "SSN: [SSN], " + "x" * 40 + " 987-65-4320", 3: "é ssn [SSN]"}


def test_redaction(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[9].startswith("mail [EMAIL][EMAIL], [EMAIL] 300.1.1.1 [IP].5 +1 (555) 010-9999 4111 1111 1111 1111 4111111111111112 [IBAN] iban")
    assert got[4] == "one two three" and got[1] is None


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (_, f) in enumerate(pipeline.STAGES):
        before, docs = docs, f(spark, docs, SMALL).cache()
        if i < 4:
            assert docs.columns == before.columns
        assert docs.count() > 0
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())

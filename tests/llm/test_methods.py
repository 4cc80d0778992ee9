"""What each method decides, against independent brute force; clashing names; the pipeline stage by stage."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("meshwright.llm.queries")
from meshwright.llm import chat, minhash, mixing, pii, quality, toxicity, url_filter  # noqa: E402
from meshwright.llm import queries as q  # noqa: E402

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


CLASHES = ["__q", "__q_", "__m", "__spans", "__SPANS_", "__toxic", "hit", "host", "Rule", "row", "text.x", "words", "a", "b", "n", "h", "block", "size"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = documents(spark, SMALL).limit(40)
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"v{i}") if i % 2 else F.lit(i))
    return docs.cache()


def test_clashing_names(spark, clashing):
    columns, kept = clashing.columns, [f"`{c}`" for c in CLASHES]
    own = tuple(clashing.select(*kept).first())
    for out in (quality.keep_good(clashing), minhash.dedup(clashing), pii.redact(clashing), mixing.mix(clashing)):
        assert out.columns == columns
        rows = out.select(*kept).collect()
        assert rows and all(tuple(r) == own for r in rows)
    for out, name in ((quality.judge(clashing), "__q__"), (pii.find(clashing), "__spans__"), (toxicity.score(clashing, toxicity.Model({}, 1.0, 1.0, 1.0, 0.0)), "__toxic_")):
        assert out.columns == [*columns, name]
        assert tuple(out.select(*kept).first()) == own
    pages = clashing.withColumn("url", F.lit("http://a.net/x"))
    judged = url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES))
    assert judged.columns == [c for c in pages.columns if c.lower() not in ("host", "rule")] + ["host", "path", "rule", "verdict"]
    assert judged.select("hit", "host", "path", "rule", "verdict").first() == (CLASHES.index("hit"), "a.net", "/x", "net/", "block")


def test_chat_clashes(spark):
    rows = [("c1", 0, "assistant", "hi", "no parts", 7), ("c1", 1, "user", "x" * 300_000 + "<|end|>", None, 8)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, parts string, turns int")
    r = chat.format_frame(frame).first()
    assert (r["conv_id"], r["n_turns"], r["loss_chars"], r["attachments"]) == ("c1", 2, 2, [])
    parts = "array<struct<type:string,ref:string,units:int,text:string>>"
    frame = spark.createDataFrame([(1, 0, "assistant", "end", [("text", None, None, "see "), ("image", "r", 2, None), (None, None, None, None)])], f"conv_id int, turn int, role string, text string, parts {parts}")
    r = chat.format_frame(frame).first()
    assert r["formatted"] == "<|turn:assistant|>see <|image:0|><|document:1|>end<|end|>"
    assert [(a["type"], a["ref"], a["tokens"], r["formatted"][a["offset"] :].startswith(f"<|{a['type']}:{a['index']}|>")) for a in r["attachments"]] == [("image", "r", 425, True), ("document", "", 310, True)]
    assert r["loss_sha256"] == hashlib.sha256(b"see end").hexdigest()


def test_chat_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(0, "user", q.SAID), (1, "assistant", q.SAID)]
    got = {r["conv_id"]: r for r in q.op9_chat(spark, SMALL).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        extra = sum(len(re.findall(r"[\\<|]", r + x)) for _, r, x in own)
        assert got[c]["formatted_chars"] == sum(len("<|turn:|><|end|>") + len(r) + len(x) for _, r, x in own) + extra
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()


def test_schedules_invert(spark):
    shares = [i / 50 for i in range(51)]
    frame = spark.createDataFrame([(s,) for s in shares], "s double")
    for knots in mixing.SCHEDULES:
        t = np.linspace(0, 1, 200_001)
        rate = np.interp(t, [a for a, _ in knots], [b for _, b in knots])
        total = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        got = [r[0] for r in frame.select("s", mixing.invert(F.col("s"), knots).alias("t")).orderBy("s").select("t").collect()]
        assert np.abs(np.interp(got, t, total / total[-1]) - shares).max() < 1e-6


def test_positions_follow_schedules(spark):
    rows = mixing.place(documents(spark, MID)).where("size > 0").collect()
    order = sorted({r["source"] for r in rows if r["source"] is not None})
    for r in rows:
        kind = (order.index(r["source"]) if r["source"] is not None else len(order)) % 3
        for v in r["visits"]:
            assert 0 <= v["position"] <= 1 and 0 < v["words"] <= r["size"]
    by = defaultdict(list)
    for r in rows:
        by[r["source"]] += [(v["position"], v["words"], r["target"]) for v in r["visits"]]
    for s, own in by.items():  # up to a copy's middle stands what the integral of its source's schedule asks for
        knots = mixing.SCHEDULES[(order.index(s) if s is not None else len(order)) % 3]
        t = np.linspace(0, 1, 200_001)
        rate = np.interp(t, [a for a, _ in knots], [b for _, b in knots])
        total = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        at, n, target = map(np.array, zip(*sorted(own)))
        assert np.abs((np.cumsum(n) - n / 2) / target - np.interp(at, t, total / total[-1])).max() < 1e-6
        assert abs(n.sum() - target[0]) < 1.01


def lexicon_brute(rows):
    """(feature -> odds) from (text, toxic), by the definition."""
    count = {True: Counter(), False: Counter()}
    n = Counter()
    for text, bad in rows:
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        count[bad].update({*words, *("^" + w[: toxicity.STEM] for w in words)})
        n[bad] += 1
    a0 = toxicity.PRIOR_SHARE * (n[True] + n[False])
    out = {}
    for w in count[True] | count[False]:
        y, x = count[True][w], count[False][w]
        a = a0 * (y + x) / (n[True] + n[False])
        odds = math.log((y + a) / (n[True] + a0)) - math.log((x + a) / (n[False] + a0))
        z = odds / math.sqrt(1 / (y + a) + 1 / (x + a))
        if y >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z and odds >= toxicity.LEAST_ODDS:
            out[w] = odds
    return out


def best_segments(full):
    def split(a, b):
        best = max(((round(sum(full[i:j]), 12), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1) if full[i] > 0 and full[j - 1] > 0), default=(0,))
        return [] if best[0] <= 1e-12 else [*split(a, best[3]), best[3:], *split(best[4], b)]

    return split(0, len(full))


def test_toxic_scores(spark):
    docs, labels = documents(spark, MID).select("doc_id", "text"), spark.read.parquet(f"{MID}/labels.parquet")
    model = toxicity.fit(docs, labels)
    import zlib

    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    learnt = [(text[r["doc_id"]], r["toxic"] == 1) for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = lexicon_brute(learnt)
    assert set(model.scores) == set(want) and all(abs(model.scores[w] - v) < 1e-9 for w, v in want.items())
    # K is the likeliest one: the derivative of the likelihood of plain texts' maxima is zero there.
    maxima = [toxicity.longest(t or "", model.scores) for t, bad in learnt if not bad]
    maxima = [m for m in maxima if m[1] > 0]
    assert not maxima or abs(len(maxima) / model.scale - sum(n * math.exp(-model.rate * s) for n, s in maxima)) < 1e-6 * len(maxima) / model.scale
    got = {r["doc_id"]: r["__toxic"] for r in toxicity.score(docs, model).collect()}
    short = [i for i, t in text.items() if len(re.findall(r"[^\W_]+", t or "")) <= 120][:150]
    assert len(short) > 50
    for i in short:
        tokens = [w for w in re.split(r"[\W_]+", (text[i] or "").lower()) if w]
        each = [max(want.get(w, 0.0), want.get("^" + w[:4], 0.0)) - toxicity.MARGIN for w in tokens]
        sums = sorted((sum(each[a:b]) for a, b in best_segments(each)), reverse=True)
        area = math.log(model.scale * max(1, len(tokens)))
        x = max([-area, *(sum(model.rate * s - area for s in sums[:r]) + math.lgamma(r + 1) for r in range(1, len(sums) + 1))])
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-(model.slope * x + model.offset)))) < 1e-9


def test_expectation_maximisation(spark):
    rows = quality.judge(documents(spark, MID), keep=["doc_id"]).collect()
    votes = np.array([r["__q"]["votes"] for r in rows])
    weak = max(2.0, 0.002 * len(votes))
    cast = np.abs(votes).sum(1)
    good = np.clip(0.5 + 0.5 * votes.sum(1) / np.maximum(1, cast) - 0.1, 0.01, 0.99)
    for _ in range(quality.EM_ROUNDS):  # row by row, not by pattern
        prior = (good.sum() + weak) / (len(good) + 2 * weak)
        odds = np.full(len(good), math.log(prior / (1 - prior)))
        for r in range(votes.shape[1]):
            v = votes[:, r]
            a = np.clip((good[v > 0].sum() + 0.8 * weak) / (good[v != 0].sum() + weak), 0.5, 0.995)
            b = np.clip(((1 - good)[v < 0].sum() + 0.8 * weak) / ((1 - good)[v != 0].sum() + weak), 0.05, 0.995)
            odds += np.where(v > 0, math.log(a / (1 - b)), np.where(v < 0, math.log((1 - a) / b), 0))
        good = 1 / (1 + np.exp(-odds))
    got = np.array([r["__q"]["quality"] for r in rows])
    assert np.abs(got - good).max() < 1e-6
    assert all(r["__q"]["kept"] == (not r["__q"]["base_failed"] and g >= 0.5) for r, g in zip(rows, got))


def test_quality_tells_both_sides(spark):
    kept = {r["doc_id"]: r["__q"]["kept"] for r in quality.judge(documents(spark, MID), keep=["doc_id"]).collect()}
    labels = [(r["quality"], kept[r["doc_id"]]) for r in spark.read.parquet(f"{MID}/labels.parquet").collect() if r["doc_id"] in kept and r["quality"] is not None]
    share = {side: sum(k for s, k in labels if s == side) / sum(s == side for s, _ in labels) for side in (0, 1)}
    assert share[1] >= 0.97 and share[0] <= 0.2


def more_spans(text):
    """The spans that the method adds."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        bare = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            out.append(("iban", m.start(), m.end()))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if m[0][:3] not in ("000", "666") and re.search("ssn|social|security", text[max(0, m.start() - 40) : m.start()].lower()):
            out.append(("ssn", m.start(), m.end()))
    return out


def test_added_spans(spark):
    rng = random.Random(2)
    texts = [r["text"] or "" for r in documents(spark, MID).collect()]
    for _ in range(300):
        bban = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in bban + "DE00")) % 97
        iban = f"DE{check:02d}{bban}"
        if rng.random() < 0.3:
            iban = iban[:5] + str((int(iban[5]) + 1) % 10) + iban[6:]
        if rng.random() < 0.5:
            iban = " ".join(iban[i : i + 4] for i in range(0, 22, 4))
        ssn = f"{rng.choice(['000', '123', '666', '987'])}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
        texts.append(rng.choice(["é my ", "x"]) + iban + rng.choice([" and ", "", " ssn "]) + ssn + "z" * rng.randint(0, 50) + " " + ssn)
    texts.append("ssn 123-45-6789 " * 3000)  # many spans far inside
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = 0
    for r in pii.find(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["__spans"] if s["kind"] not in pii.BASE]
        assert got == sorted(more_spans(r["text"])), r["text"][:200]
        seen += len(got)
    assert seen > 3050


def test_many_near_copies(spark):
    """2,000 near copies at the default constants, many of them linked only through others or not at all."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(2000):
        own = list(base)
        for k in rng.sample(range(60), rng.choice([1, 1, 2, 2, 3])):
            own[k] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    number = {}
    grid = np.zeros((len(sets), len({x for s in sets for x in s})), np.float32)
    for i, s in enumerate(sets):
        for x in s:
            grid[i, number.setdefault(x, len(number))] = 1
    common, n = grid @ grid.T, grid.sum(1)
    linked = 100 * common >= 75 * (n[:, None] + n[None] - common)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None], len(sets)).min(1)
        if (new == label).all():
            break
        label = new
    assert 1 < len(set(label.tolist())) < 2000
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(2000)] == label.tolist()


def near_classes(rows):
    from test_llm import near_brute

    return {i: c for i, _, c, _ in near_brute(rows)}


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A table of awkward documents, and an empty one."""
    from test_llm import AWKWARD, DOCS

    out = []
    for n in (None, 0):
        d = str(tmp_path_factory.mktemp("few"))
        spark.createDataFrame(AWKWARD[:n], DOCS).write.parquet(f"{d}/documents.parquet")
        out.append(d)
    return out


@pytest.mark.parametrize("d", [SMALL, 0, 1])
def test_pipeline_by_stages(spark, d, few):
    import public_tokenizers as P
    import tiktoken
    from test_llm import BASE, words

    pipeline = pytest.importorskip("corpus_pipeline")
    d = few[d] if isinstance(d, int) else d
    docs, before = documents(spark, d), None
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, docs.collect(), out.collect()))
        docs = out
    stages = dict((n, (a, b)) for n, a, b in seen)

    before, after = stages["quality rules"]
    kept = quality.judge(documents(spark, d)).where("__q.kept").drop("__q").collect()
    assert Counter(map(tuple, after)) == Counter(map(tuple, kept)) and not Counter(map(tuple, after)) - Counter(map(tuple, before))

    before, after = stages["near duplicates"]
    comp = near_classes([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted({c for i, c in comp.items() if c is not None})
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))

    before, after = stages["personal data"]

    def redacted(t):
        spans = sorted([(m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])] + [(a, b, k) for k, a, b in more_spans(t or "")])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out.append(t[at:a] + f"[{k.upper()}]")
            at = max(at, b)
        return "".join(out) + t[at:] if spans else t

    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], redacted(r["text"])) for r in before)

    before, after = stages["mixing"]
    frame = spark.createDataFrame(before, documents(spark, d).schema)
    taken = Counter()
    for r in mixing.place(frame).collect():
        taken[r["key"], r["source"]] += r["taken"]
    got = Counter()
    for r in after:
        got[r["doc_id"], r["source"]] += len(words(r["text"]))
    assert got == +taken

    before, after = stages["byte-level BPE"]
    with open(P.path(q.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == Counter((r["doc_id"], tuple(e.encode_ordinary(r["text"] or ""))) for r in before)
    run = pipeline.run(spark, d)
    assert sorted(run.columns) == sorted(docs.columns) and run.count() == docs.count()

"""Toxic passages by maximum-scoring segments.

Features of a token are its lower-cased word and the word's first STEM letters.
Log-odds between toxic and other labelled documents, with a Dirichlet prior in
proportion to the whole sample, score each feature; a token takes the larger of
its two scores less MARGIN, so that plain text drifts downward. A linear-time
scan finds all maximal-scoring segments of a text. With the scores' spread in
plain text, a segment's score becomes an extreme-value E-value, the joint E-value
of a text's best r segments sums up the text, and a logistic curve turns it into
a score from 0 to 1.

Learning takes at most SAMPLE labelled rows, which bounds the lexicon; scoring
covers every text whole.

Defined cases: a null or empty text has no tokens and gets the score of no
evidence; rows are scored one by one, so repeated rows, null ids and other
columns change nothing; without labelled rows of both kinds every score is the
share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import free_name, quoted, text_of

SAMPLE = 20_000
STEM = 4
MARGIN = 0.3
PRIOR_SHARE = 0.025
LEAST_Z, LEAST_ODDS, LEAST_DOCS = 3.0, 2.0, 4
FOLDS = 5
TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  #: of whole words, and of stems with "^" in front
    rate: float  #: lambda of the extreme-value law
    scale: float  #: K of it
    slope: float
    offset: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def segments(at: list[int], scores: list[float], margin: float = MARGIN) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), where tokens ``at`` have ``scores`` > 0 and all others -margin.

    One pass with a stack of candidates. Each holds the running totals left of it and at its end, and the place of
    the nearest candidate that starts from a lower total, so that a search leaps over those that can't help.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total -= margin * (i - last - 1)
        begin, left = i, total
        total, last = total + s, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((begin, i + 1, left, total, j))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def marked(text: str, known: dict[str, float]) -> tuple[int, list[int], list[float]]:
    """Number of tokens, and places and scores of those with a score above zero."""
    tokens = TOKEN.findall(text.lower())
    get, at, scores = known.get, [], []
    for i, w in enumerate(tokens):
        s = max(get(w, 0.0), get("^" + w[:STEM], 0.0)) - MARGIN
        if s > 0:
            at.append(i)
            scores.append(s)
    return len(tokens), at, scores


def longest(text: str, known: dict[str, float]) -> tuple[float, float]:
    """Number of tokens and the largest segment score, 0 if there is none."""
    n, at, scores = marked(text, known)
    return float(n), max((s for *_, s in segments(at, scores)), default=0.0)


def evidence(text: str, model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-log of the text's joint E-value, and its significant passages (start and end in tokens, score, E-value)."""
    n, at, scores = marked(text, model.scores)
    area = math.log(model.scale * max(1, n))
    if not at:
        return -area, []
    found = sorted(segments(at, scores), key=lambda x: -x[2])
    best, total = -area, 0.0
    for r, (_, _, s) in enumerate(found, 1):
        total += model.rate * s - area
        best = max(best, total + math.lgamma(r + 1))
    passages = [(a, b, s, math.exp(min(50.0, area - model.rate * s))) for a, b, s in found]
    return best, [p for p in passages if p[3] < 0.05]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows, chosen by hash among those not held out."""
    chosen = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(label) == 1).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "bad").limit(sample)
    # At most ``sample`` small rows, so they are sent to where the texts are.
    rows = docs.select(F.col(key).alias("key"), text_of(f"`{text}`").alias("text")).join(F.broadcast(chosen), "key")
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    features = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM)))))
    kinds = rows.groupBy("bad").agg(F.count("*").alias("n"), F.sum(F.size(words)).alias("tokens")).collect()
    n = {r["bad"]: r["n"] for r in kinds}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        share = min(0.999, max(1e-6, bad / max(1, bad + good)))
        return Model({}, 1.0, 1.0, 0.0, math.log(share / (1 - share)))
    a0 = PRIOR_SHARE * (bad + good)
    counts = rows.select("bad", F.explode(features).alias("w")).groupBy("w").agg(F.count_if("bad").alias("y"), F.count_if(~F.col("bad")).alias("x"))
    prior = a0 * (F.col("y") + F.col("x")) / (bad + good)
    counts = counts.withColumn("a", prior).withColumn("odds", F.log((F.col("y") + F.col("a")) / (bad + a0)) - F.log((F.col("x") + F.col("a")) / (good + a0)))
    counts = counts.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("y") + F.col("a")) + 1 / (F.col("x") + F.col("a"))))
    # Each kept feature stands in LEAST_DOCS toxic documents of a bounded sample, which bounds this table.
    lexicon = counts.where((F.col("y") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).collect()
    scores = {r["w"]: r["odds"] for r in lexicon}
    plain = max(1.0, float(next(r["tokens"] for r in kinds if not r["bad"]) or 1))
    mass = [((r["x"] + r["a"]) / plain, r["odds"] - MARGIN) for r in lexicon]
    rate = decay(mass)

    @F.pandas_udf("tokens double, best double")
    def maxima(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([longest(t, scores) for t in texts], columns=["tokens", "best"])

    # A number or two, and a label, for each row of the bounded sample come to the driver.
    calm = rows.where("NOT bad").select(maxima("text").alias("x")).select("x.*").where("best > 0").collect()
    scale = location([(r["tokens"], r["best"]) for r in calm], rate)
    draft = Model(scores, rate, scale, 1.0, 0.0)

    @F.pandas_udf("double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([evidence(t, draft)[0] for t in texts], dtype=float)

    seen = rows.select("bad", told("text").alias("x")).collect()
    slope, offset = logistic(np.array([r["x"] for r in seen]), np.array([float(r["bad"]) for r in seen]))
    return Model(scores, rate, scale, slope, offset)


def location(maxima: list[tuple[float, float]], rate: float) -> float:
    """K of the law P(best < s) = exp(-K * tokens * exp(-rate * s)): its likeliest value for plain texts' (tokens, best); 1 if there are none."""
    return len(maxima) / math.fsum(n * math.exp(-rate * s) for n, s in maxima) if maxima else 1.0


def decay(mass: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(rate * score)] = 1 in plain text, by bisection."""
    rest = max(0.0, 1 - sum(p for p, _ in mass))

    def over(t: float) -> float:
        return rest * math.exp(-t * MARGIN) + sum(p * math.exp(min(600.0, t * s)) for p, s in mass) - 1

    low, high = 1e-4, 20.0
    if not mass or over(low) > 0:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a ridge that keeps a clean split finite."""
    mean, spread = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / spread, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / spread, w[1] - w[0] * mean / spread


def score(docs: DataFrame, model: Model, text: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct of score and passages (start and end in tokens, score, e_value), a last column: ``name``, or the first free one of __toxic, __toxic_, ..."""
    name = free_name(docs.columns, "__toxic") if name is None else name
    out = "score double, passages array<struct<start:int,end:int,score:double,e_value:double>>"

    @F.pandas_udf(out)
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                x, passages = evidence(t, model)
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * x + model.offset))))
                rows.append((p, [{"start": a, "end": b, "score": s, "e_value": e} for a, b, s, e in passages]))
            yield pd.DataFrame(rows, columns=["score", "passages"])

    return docs.withColumn(name, told(text_of(quoted([text])[0])))

"""Quality rules by weak supervision (native).

Each rule votes +1 (good), -1 (poor) or 0 (abstains) on a document. Votes are
counted by pattern, at most 3 ** len(RULES) of them whatever the input, and
expectation-maximisation over that table estimates how often each rule is right
on good and on poor documents. A document's posterior probability of being good
then decides, in place of a demand that every rule pass.

Defined cases: a null or empty text has no words and fails; rows are judged one
by one, so repeated rows, null ids and other columns change nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import WORD, cut, free_name, let, quoted, text_of, words_of

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
EM_ROUNDS = 60
#: Common function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for with on as was are be this by at from have or an not "
    "le la les de des du et un une est que qui dans pour par sur avec au en "
    "der die das und ist von zu den mit ein eine nicht für auf im dem es "
    "el los las del y que en por con para una se lo como más"
).split()
RULES = ("length", "symbols", "dup_lines", "repeats", "word_length", "function_words", "capitals", "exclaims", "separators")


def count_repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    n = F.size(words) - (WINDOW - 1)
    shifted = F.arrays_zip(*[F.slice(words, k, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(1, WINDOW + 1)])
    hashes = F.transform(shifted, lambda w: F.xxhash64(w))

    def covered(h: Column) -> Column:
        def again(ordered: Column) -> Column:
            def beside(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(ordered, beside), lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)

        return let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again), total)

    return hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, a struct of all columns of ``docs``, beside ``q``, a struct of counts over whole texts."""
    t = F.col("text")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(docs.columns))])
    df = docs.select(row.alias("row"), text_of(quoted([text])[0]).alias("text"))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    def count_mark(mark: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))).cast("long")

    listed = [*FUNCTION_WORDS, *(w.capitalize() for w in FUNCTION_WORDS)]
    df = df.withColumn("w", words_of(t)).withColumn("l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    hashes, repeats = count_repeat_words(F.col("w"))
    df = df.withColumn("h", hashes)
    return df.select(
        "row",
        F.struct(
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            count("[#*$%&|<>]").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            repeats(F.col("h")).alias("n_repeat_words"),
            F.size("l").cast("long").alias("n_lines"),
            F.size(F.array_intersect("w", F.array(*map(F.lit, dict.fromkeys(listed))))).cast("long").alias("n_function"),
            count("[A-ZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ]").alias("n_capitals"),
            count_mark("!").alias("n_exclaims"),
            count_mark("|").alias("n_bars"),
        ).alias("q"),
    )


def vote_columns(q: Column) -> list[Column]:
    """One vote a rule, in the order of RULES."""
    n, chars = q["n_words"], q["word_chars"]

    def vote(poor: Column, good: Column) -> Column:
        return F.when(poor, -1).when(good, 1).otherwise(0)

    return [
        vote(n < MIN_WORDS, n >= 25),
        vote(20 * q["n_symbols"] > chars, 200 * q["n_symbols"] <= chars),
        vote((3 * q["n_dup_lines"] > q["n_lines"]), (q["n_dup_lines"] == 0) & (q["n_lines"] > 1)),
        vote(100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * n, (20 * q["n_repeat_words"] <= n) & (n >= WINDOW)),
        vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 10 * n) & (n > 0)),
        vote((q["n_function"] == 0) & (n >= 20), q["n_function"] >= 3),
        vote(2 * q["n_capitals"] > chars, (8 * q["n_capitals"] <= chars) & (n > 0)),
        vote(4 * q["n_exclaims"] > n, 50 * q["n_exclaims"] <= n),
        vote(5 * q["n_bars"] > n, (q["n_bars"] == 0) & (n > 0)),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, count): prior of good and, for each rule, how often it is right on good and on poor.

    Starts from the majority of votes. Pseudo-counts, in proportion to the rows, keep each rule better than chance.
    """
    total = sum(c for _, c in patterns)
    if not total:
        return 0.5, [(0.8, 0.8)] * len(RULES)
    weak = max(2.0, 0.002 * total)
    good = [min(0.99, max(0.01, 0.5 + 0.5 * sum(v) / max(1, sum(map(abs, v))) - 0.1)) for v, _ in patterns]
    prior, right = 0.5, [(0.8, 0.8)] * len(RULES)
    for _ in range(rounds):
        prior = (sum(g * c for g, (_, c) in zip(good, patterns, strict=True)) + weak) / (total + 2 * weak)
        right = []
        for r in range(len(RULES)):
            rates = []
            for sign, share in ((1, good), (-1, [1 - g for g in good])):
                voted = sum(s * c for s, (v, c) in zip(share, patterns, strict=True) if v[r])
                hit = sum(s * c for s, (v, c) in zip(share, patterns, strict=True) if v[r] == sign)
                rates.append(min(0.995, max(0.5 if sign > 0 else 0.05, (hit + 0.8 * weak) / (voted + weak))))
            right.append(tuple(rates))
        good = [posterior(v, prior, right) for v, _ in patterns]
    return prior, right


def weights(a: float, b: float) -> tuple[float, float]:
    """Log odds that a vote for good, and one for poor, adds."""
    return math.log(a / (1 - b)), math.log((1 - a) / b)


def posterior(votes: tuple[int, ...], prior: float, right: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (a, b) in zip(votes, right, strict=True):
        odds += weights(a, b)[0] if v > 0 else weights(a, b)[1] if v < 0 else 0.0
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of counts, votes, quality (the posterior), base_failed and kept.

    The struct is the last column; its name is ``out``, or the first free one of __q, __q_, and so on.
    """
    columns = docs.columns if keep is None else keep
    out = free_name(columns, "__q") if out is None else out
    carried = docs.select(*quoted(list(dict.fromkeys([*columns, text]))))
    at = {c: i for i, c in enumerate(carried.columns)}
    seen = measures(carried, text)
    seen = seen.select(*[F.col(f"row.c{at[c]}").alias(f"c{i}") for i, c in enumerate(columns)], "q")
    seen = cut(seen.withColumn("q", F.col("q").withField("votes", F.array(*vote_columns(F.col("q"))))), "quality")
    counted = seen.groupBy(F.col("q.votes").alias("votes")).count().collect()  # at most 3 ** len(RULES) rows
    prior, right = fit(sorted((tuple(r["votes"]), r["count"]) for r in counted))
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, (a, b) in enumerate(right):
        up, down = weights(a, b)
        v = F.col("q.votes")[r]
        odds = odds + F.when(v > 0, up).when(v < 0, down).otherwise(0.0)
    probability = F.round(1 / (1 + F.exp(-odds)), 9)
    q = F.col("q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    judged = q.withField("quality", probability).withField("base_failed", failed).withField("kept", ~failed & (probability >= 0.5))
    return seen.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], judged.alias(out))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    judged = judge(docs, text)
    return judged.where(F.col(quoted(judged.columns[-1:])[0])["kept"]).select(*quoted(docs.columns))

"""Personal data: patterns propose spans, checks confirm them, context adjusts scores (native).

Each kind has a pattern, a check on the matched string, a base score and context
words. Matches of a kind are leftmost and don't overlap; a match that its check
refuses is dropped, and the search goes on behind it. Offsets are code points,
ends exclusive: a text is split at the matches, and running lengths of pieces and
matches give the offsets. Repetition is possessive and start positions are held
to the start of a run, so that long texts are scanned once.

Defined cases: a null or empty text has no spans; rows are judged one by one, so
repeated rows, null ids and other columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import free_name, let, quoted, running, text_of

CONTEXT = 40
CHUNK = 4096
KEEP = 0.5
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    d = F.reverse(digits_of(x))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(x: Column) -> Column:
    """Of an account number: the first four characters go last, letters count 10 to 35; the remainder is 1."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1


def octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.expr("0") + F.right(p, F.lit(3)).cast("int") <= 255))


def phone_digits(x: Column) -> Column:
    return F.length(digits_of(x)).between(9, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    context: str  #: a pattern of words that, shortly before, make a match likelier
    hint: str  #: a cheap pattern without which no match exists
    base: bool = True


#: The patterns of the kinds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.6, "ip|address|host|server", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda x: F.length(digits_of(x)).between(13, 19) & luhn(x), 0.8, "card|visa|credit|pay", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, 0.7, "phone|tel|call|fax|mobile", r"\+[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.9, "iban|account|bank|konto", r"[A-Z]{2}[0-9]{2}", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda x: ~F.substring(x, 1, 3).isin("000", "666"), 0.3, "ssn|social|security", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def chunked(text: Column) -> Column:
    """The text in pieces of CHUNK characters, so that a substring far inside needn't count from the start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a chunked text."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(some, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind in a text, by start."""
    def span(x: Column, chunks: Column) -> Column:
        start = x["e"] - F.length(x["m"])
        near = F.lower(between(chunks, F.greatest(start - CONTEXT, F.lit(0)), start))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), x["e"].alias("end"), score.alias("score"))

    def confirmed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: (F.length(x["m"]) + F.length(x["g"])).cast("long")), lambda a, v: a + v, F.lit(0).cast("long"))
        return F.filter(F.zip_with(parts, ends, lambda p, e: F.struct(p["m"].alias("m"), e.alias("e"))), lambda x: kind.check(x["m"]))

    def parted(found: Column) -> Column:
        gaps = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
        return F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    matches = let(let(F.regexp_extract_all(text, F.lit(kind.pattern), 0), parted), confirmed)
    spans = let(chunked(text), lambda chunks: F.transform(matches, lambda x: span(x, chunks)))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(kind.hint), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """``docs`` with all spans, by kind in the order of KINDS, then start, as a last column: ``out``, or the first free name of __spans, __spans_, ..."""
    t = text_of(quoted([text])[0])
    out = free_name(docs.columns, "__spans") if out is None else out
    return docs.withColumn(out, F.concat(*[spans_of(t, k).cast(f"array<{SPAN}>") for k in KINDS]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; of overlapping spans the first names the gap."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(docs.columns))])
    found = find(docs.select(row.alias("row"), F.col(quoted([text])[0]).alias("text")), out="spans")
    found = found.withColumn("spans", F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    found = found.withColumn("ends", running(F.col("spans.end"), lambda a, v: F.greatest(a, v), F.lit(0).cast("long")))
    t, n = F.col("text"), F.size("spans")
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", 1, F.greatest(n - 1, F.lit(0))))
    gaps = F.arrays_zip(F.col("spans").alias("s"), before.alias("b"))

    def filled(chunks: Column) -> Column:
        pieces = F.transform(gaps, lambda x: F.when(x["s"]["start"] >= x["b"], F.concat(between(chunks, x["b"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(chunks, F.element_at("ends", -1), F.length(t).cast("long")))

    said = F.when(n > 0, let(chunked(t), filled)).otherwise(t)
    return found.select(*[(said if c.lower() == text.lower() else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])

"""URL rules by hashed host-suffix and path-prefix expressions (native).

A rule is (host, path, verdict). It fits its host and all subdomains where the
url's path starts with the rule's path. A url is expanded into one expression for
each shape (labels of the host, length of the path) that some rule has, and
joined to the rules on a short hash prefix; the full digest confirms a match and
the longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and
fits no rule; repeated rows each get their verdict; an empty table or an empty
rule list gives the default verdict. Other columns travel along, but those named
host, path, rule or verdict (in any case) give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import lower_ascii, quoted, text_of, values

PREFIX_HEX = 8
#: The rules of the query op2_url_filter.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    if not rules:
        return values(spark, [("", "", "")], ["host", "path", "verdict"]).where("false")
    return values(spark, sorted(set(rules)), ["host", "path", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    left = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(left))])
    link = F.col(quoted([url])[0])
    keyed = pages.select(row.alias("row"), host_of(link).alias("host"), path_of(link).alias("path"))
    expr = F.concat("host", "path")
    listed = rules.select(
        F.struct(F.length(expr).alias("long"), F.length("host").alias("host_long"), (F.col("verdict") == "block").alias("blocks"), expr.alias("rule"), F.col("verdict").alias("verdict")).alias("hit"),
        F.sha2(expr, 256).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("reach"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    # Shapes, not rules: a host has at most 128 labels and few path lengths occur.
    shapes = [(r["labels"], r["reach"]) for r in listed.select("labels", "reach").distinct().collect()]
    h, p = F.col("host"), F.col("path")
    labels = F.size(F.split(h, r"\."))
    none = F.lit(None).cast("string")
    forms = F.filter(
        F.array(none, *[F.when((labels >= n) & (F.length(p) >= m), F.concat(F.substring_index(h, ".", -n), F.substring(p, 1, m) if m else F.lit(""))) for n, m in sorted(shapes)]),
        lambda x: x.isNotNull(),
    )
    urls = keyed.select("host", "path").distinct()  # one row for each url part however often it occurs
    digests = urls.select("host", "path", F.explode(forms).alias("form")).select("host", "path", F.sha2("form", 256).alias("full"))
    met = digests.withColumn("prefix", F.substring("full", 1, PREFIX_HEX)).join(listed.select("prefix", "digest", "hit"), "prefix").where("full = digest")
    best = met.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    out = keyed.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(left)], "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))

"""Queries of a social application: timeline, profile, search and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.graph import PropertyGraph


def posts_of(g: PropertyGraph, authors: DataFrame, wrote: str, when: str) -> DataFrame:
    """(id, author, <when>): posts by ``authors``, a column ``author``."""
    written = g.outgoing_of(authors.select(F.col("author").alias("src")), wrote).select(F.col("src").alias("author"), F.col("dst").alias("id"))
    return g.vertices.select("id", when).join(written, "id")


def timeline(g: PropertyGraph, user: int, follow: str, wrote: str, liked: str, when: str, first: int = 50, limit: int = 20) -> DataFrame:
    """(id, author, <when>, user_liked): the newest posts of the first ``first`` whom ``user`` follows, by id."""
    near = g.pairs(follow).where(F.col("src") == user).select(F.col("dst").alias("author")).orderBy("author").limit(first)
    newest = posts_of(g, near, wrote, when).orderBy(F.desc(when), "id").limit(limit)
    likes = g.pairs(liked).where(F.col("src") == user).select(F.col("dst").alias("id"), F.lit(True).alias("__liked"))
    rows = newest.join(likes, "id", "left").select("id", "author", when, F.coalesce("__liked", F.lit(False)).alias("user_liked"))
    return rows.orderBy(F.desc(when), "id")


def follows(a: int, b: int, label: str) -> Column:
    """Whether a follows b, as an aggregate over edges."""
    return F.count_if((F.col("src") == a) & (F.col("dst") == b) & (F.col("label") == label)) > 0


def profile(g: PropertyGraph, user: int, viewer: int, follow: str, wrote: str, when: str, keys: list[str], limit: int = 20) -> DataFrame:
    """(id, keys, following, followed_by, post, <when>): a row for each of the user's newest posts, one with nulls if there is none."""
    ends = g.edges.where(F.col("src").isin(user, viewer) & F.col("dst").isin(user, viewer))
    flags = ends.agg(follows(viewer, user, follow).alias("following"), follows(user, viewer, follow).alias("followed_by"))
    who = g.lookup([user]).select("id", *keys)
    posts = posts_of(g, who.select(F.col("id").alias("author")), wrote, when).orderBy(F.desc(when), "id").limit(limit)
    posts = posts.select(F.col("author").alias("id"), F.col("id").alias("post"), when)
    return who.join(flags, F.lit(True)).join(posts, "id", "left")


def search(g: PropertyGraph, label: str, needle: str, keys: list[str], limit: int = 10) -> DataFrame:
    """Ids of the first ``limit`` vertices that hold ``needle`` in any of ``keys``."""
    test = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(k), F.lit(needle)), F.lit(False)) for k in keys])
    return g.vertices.where((F.col("label") == label) & test).select("id").orderBy("id").limit(limit)


def clamped(log: DataFrame, key: str, at: str, change: str, block: int = 1 << 16) -> DataFrame:
    """(key, n): counters that begin at 0 and never fall below it, after all changes in order of ``at``.

    A counter ends at the sum of its changes less the lowest running sum, or less 0 if none is below. The log is cut into
    blocks of ``at`` (a whole number); each is summed by itself, and a key's blocks are combined after, so that a key with
    most of the rows is spread over tasks.
    """
    rows = log.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        key, F.col(at).alias("__at"), F.floor(F.col(at) / block).alias("__block"), F.coalesce(F.col(change), F.lit(0)).cast("long").alias("__change")
    )
    inside = Window.partitionBy(key, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.withColumn("__upto", F.sum("__change").over(inside)).groupBy(key, "__block").agg(F.sum("__change").alias("__sum"), F.min("__upto").alias("__low"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__low", F.col("__low") + F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    return blocks.groupBy(key).agg((F.sum("__sum") - F.least(F.min("__low"), F.lit(0))).alias("n"))

"""Digests, near-verbatim containment, and retraction of rewritten suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E

#: A line this long found as it is, or this share of the shingles, makes a text a near copy.
LONG_LINE, SHARE, SHINGLE = 40, 0.6, 8


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length, null told from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``digest, copies, first``: texts that several keys hold, compared in normalized form."""
    d = df.where(~E.blank(text)).select(F.col(key).alias("k"), F.sha2(E.normalized(text), 256).alias("digest"))
    return d.groupBy("digest").agg(F.countDistinct("k").alias("copies"), F.min("k").alias("first")).where("copies > 1")


def near_verbatim(text: Column, body: Column) -> Column:
    """Whether a text repeats a body nearly verbatim.

    Either a normalized line of the body with at least ``LONG_LINE`` characters
    stands in the text, or ``SHARE`` of the body's distinct character shingles do.
    """
    t, b = E.normalized(text), E.normalized(body)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: E.normalized(x)), lambda x: F.length(x) >= LONG_LINE)
    grams = lambda x: F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))  # noqa: E731  # overlapping, in one pass
    shingles = F.array_distinct(grams(b))
    enough = F.size(F.array_intersect(shingles, grams(t))) >= F.ceil(F.size(shingles) * SHARE)
    # the cheap tests come first; shingles are made only where they can decide
    return F.coalesce(F.when(t.isNull() | b.isNull(), False).when(F.exists(lines, lambda x: F.contains(t, x)), True).when((F.length(b) < SHINGLE) | (F.length(t) < SHINGLE), False).when(F.contains(t, b), True).otherwise(enough), F.lit(False))


def first_changes(old: DataFrame, new: DataFrame, chat: str, turn: str, d: str) -> DataFrame:
    """Per chat the first turn whose digest is not what it was; turns that are gone count as changed, added ones do not."""
    o, n = old.select(chat, turn, F.col(d).alias("was")), new.select(chat, turn, F.col(d).alias("is"))
    return o.join(n, [chat, turn], "left").where(~F.col("was").eqNullSafe(F.col("is"))).groupBy(chat).agg(F.min(turn).alias("first_changed"))


def retract(old: DataFrame, changes: DataFrame, chat: str, turn: str) -> DataFrame:
    """The old turns that still hold: those before their chat's first change."""
    return old.join(changes, chat, "left").where(F.col("first_changed").isNull() | (F.col(turn) < F.col("first_changed"))).drop("first_changed")


def overlap_along(rows: DataFrame, key: list[str], order: list[str], files: str) -> DataFrame:
    """Each row's file overlap with the row before it; null when either is empty or there is none before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("overlap", F.round(E.jaccard(F.lag(files).over(w), F.col(files)), 6))

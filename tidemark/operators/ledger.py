"""Byte accounting of the store and the plan that keeps it within its capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.store import current_sessions


def _array_bytes(c: str):
    return F.coalesce(F.aggregate(F.transform(c, lambda x: E.utf8_bytes(x)), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


def _decision_bytes(c: str):
    return F.coalesce(F.aggregate(F.transform(c, lambda x: E.utf8_bytes(x["what"]) + E.utf8_bytes(x["why"])), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


def charges(sessions: DataFrame, memories: DataFrame, turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """``part, session_id, bytes``, a row for every stored row; texts that are indexed are charged twice, vectors at four bytes a value."""
    owner = memories.where("id is not null").groupBy("id").agg(F.min("session_id").alias("session_id")).withColumnRenamed("id", "memory_id")
    return (
        current_sessions(sessions).select(F.lit("sessions").alias("part"), F.col("id").alias("session_id"), (E.utf8_bytes("title") + E.utf8_bytes("custom_title") + E.utf8_bytes("first_prompt_search") + _array_bytes("trailing_files")).alias("bytes"))
        .unionByName(memories.select(F.lit("memories").alias("part"), "session_id", (_decision_bytes("decisions") + _array_bytes("files_touched") + _array_bytes("pending_items")).alias("bytes")))
        .unionByName(turns.select("memory_id", (2 * (E.utf8_bytes("user_prompt") + E.utf8_bytes("assistant_response"))).alias("bytes")).join(owner, "memory_id", "left").select(F.lit("copies").alias("part"), "session_id", "bytes"))
        .unionByName(vectors.select(F.lit("vectors").alias("part"), "session_id", (4 * F.greatest(F.lit(0), F.coalesce(F.size("vector"), F.lit(0))).cast("bigint")).alias("bytes")))
    )


def totals(charged: DataFrame) -> DataFrame:
    """Rows and bytes of each part."""
    return charged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def by_chat(charged: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows and bytes of each native chat."""
    per = charged.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    s = current_sessions(sessions).select(F.col("id").alias("session_id"), "tool", "native_id", "started_at")
    return per.join(s, "session_id").groupBy("tool", "native_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("started_at").alias("started_at"))


def oldest_first(units: DataFrame, required: int, eligible: Column | str = "true") -> DataFrame:
    """The smallest prefix of whole units, oldest first, whose bytes reach ``required``.

    Units with unknown start come last; equal starts go by tool and native id.
    The running sum is taken over days first, so no task sorts all units.
    """
    u = units.where(eligible).withColumn("day", F.coalesce(F.date_trunc("day", "started_at"), F.lit("9999-12-31").cast("timestamp_ntz")))
    days = u.groupBy("day").agg(F.sum("bytes").alias("day_bytes"))
    days = days.withColumn("before_day", F.coalesce(F.sum("day_bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per day
    w = Window.partitionBy("day").orderBy(F.col("started_at").isNull(), "started_at", "tool", "native_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_day") + F.coalesce(F.sum("bytes").over(w), F.lit(0))
    return u.join(F.broadcast(days.where(F.col("before_day") < required)), "day").withColumn("before", before).where(F.col("before") < required).select("tool", "native_id", "bytes", "before")

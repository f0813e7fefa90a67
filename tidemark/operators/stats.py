"""Usage statistics over memories and projects."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import current_memories


def since(text: str, now: datetime) -> datetime:
    """The start of a window given as 30m, 24h, 7d or an ISO time."""
    m = re.fullmatch(r"(\d+)([mhd])", text.strip())
    if m:
        return now - timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def by_tool(memories: DataFrame) -> DataFrame:
    """Sessions and memories of each tool."""
    return current_memories(memories).groupBy("tool").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("memories"))


def per_session(memories: DataFrame) -> DataFrame:
    """Least, median, most memories of a session and the number of sessions; zeros when there is none."""
    n = current_memories(memories).where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return n.agg(z(F.min("n")).alias("least"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median"), z(F.max("n")).alias("most"), F.count("*").alias("sessions"))


def pending_per_session(memories: DataFrame) -> DataFrame:
    """Open items of each session."""
    return current_memories(memories).groupBy("session_id").agg(F.sum(F.greatest(F.lit(0), F.coalesce(F.size("pending_items"), F.lit(0))).cast("bigint")).alias("pending"))


def by_project(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """Memories and open items of each project."""
    m = current_memories(memories).groupBy("project_id").agg(F.count("*").alias("memories"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("pending_items"), F.lit(0))).cast("bigint")).alias("pending"))
    return m.join(projects.select(F.col("id").alias("project_id"), "path"), "project_id").select("project_id", "path", "memories", "pending")


def noise(memories: DataFrame) -> DataFrame:
    """Per tool and summarizer status: memories, those without decision and open item, those without file."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return current_memories(memories).groupBy("tool", "summarizer_status").agg(
        F.count("*").alias("memories"), F.count_if(none("decisions") & none("pending_items")).alias("noise"), F.count_if(none("files_touched")).alias("without_files"))


def health(calls: DataFrame, key: str, ok: str, at: str, event: str) -> DataFrame:
    """Per key the share of successes, whether it is half at least, and the latest failure."""
    return calls.groupBy(key).agg(F.round(F.avg(F.col(ok).cast("double")), 6).alias("ok_ratio"), (F.avg(F.col(ok).cast("double")) >= 0.5).alias("healthy"),
                                  F.max(F.when(~F.col(ok), F.struct(at, event))).alias("x")).select(key, "ok_ratio", "healthy", F.col(f"x.{event}").alias("latest_failure"))

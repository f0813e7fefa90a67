"""Purge and export plans, exclusion by tombstones, validation of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.store import current_memories, current_sessions


def without(rows: DataFrame, *tombstones: DataFrame, keys: tuple[str, ...] = ("tool", "native_id")) -> DataFrame:
    """Rows whose chat none of the tombstone tables names."""
    for t in tombstones:
        rows = rows.join(t.select(*keys).distinct(), list(keys), "left_anti")
    return rows


def purge_plan(sessions: DataFrame, memories: DataFrame, turns: DataFrame, scope: Column) -> DataFrame:
    """What a purge of the sessions in scope takes: per session its turns, stored copies and their bytes."""
    s = current_sessions(sessions).where(scope).select(F.col("id").alias("session_id"), "tool", "native_id", "project_id")
    m = memories.where("id is not null").select(F.col("id").alias("memory_id"), "session_id").distinct().join(s, "session_id")
    size = E.utf8_bytes("user_prompt") + E.utf8_bytes("assistant_response")
    copies = turns.select("memory_id", size.alias("b")).join(m.select("memory_id", "session_id"), "memory_id").groupBy("session_id").agg(F.count("*").alias("copies"), F.sum("b").alias("bytes"))
    counts = m.groupBy("session_id").agg(F.count("*").alias("turns"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return s.join(counts, "session_id", "left").join(copies, "session_id", "left").select("session_id", "tool", "native_id", "project_id", n("turns").alias("turns"), n("copies").alias("copies"), n("bytes").alias("bytes"))


def emptied_projects(sessions: DataFrame, plan: DataFrame) -> DataFrame:
    """Projects that keep no session once a plan is carried out."""
    left = current_sessions(sessions).join(plan.select(F.col("session_id").alias("id")), "id", "left_anti").select("project_id").distinct()
    return plan.select("project_id").distinct().join(left, "project_id", "left_anti")


def export(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that belong to projects at the given paths (``path``): projects, their sessions, memories and copies, by semi-joins."""
    p = tables["projects"].join(paths.select("path").distinct(), "path", "left_semi")
    s = tables["sessions"].join(p.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    m = tables["memories"].join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    t = tables["filtered_turns"].join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return {"projects": p, "sessions": s, "memories": m, "filtered_turns": t}


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every rule a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def changed(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose columns a derivation would change, null told from empty: what a backfill writes, and nothing else."""
    b = before.select(*keys, F.struct(*columns).alias("was"))
    a = after.select(*keys, F.struct(*columns).alias("is"))
    return b.join(a, keys).where(~F.col("was").eqNullSafe(F.col("is"))).select(*keys)


def import_disposition(units: DataFrame, purged: DataFrame, stored: DataFrame, consented: DataFrame) -> DataFrame:
    """Per imported chat ``purged``, ``unconsented``, ``existing`` or ``new``, in this order."""
    k = ["tool", "native_id"]
    mark = lambda df, name: df.select(*k).distinct().withColumn(name, F.lit(True))
    u = units.join(mark(purged, "_p"), k, "left").join(mark(stored, "_s"), k, "left").join(consented.select("project_id").distinct().withColumn("_c", F.lit(True)), "project_id", "left")
    return u.withColumn("disposition", F.when(F.col("_p"), "purged").when(F.col("_c").isNull(), "unconsented").when(F.col("_s"), "existing").otherwise("new")).drop("_p", "_s", "_c")


def current_turns_of(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Current turns with the chat of their stored session."""
    s = current_sessions(sessions).select(F.col("id").alias("session_id"), "tool", "native_id", "segment_index")
    return current_memories(memories).drop("tool").join(s, "session_id")

"""What is shown of stored sessions: newest activity, evidence gates, fields that are searched, lists by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.store import current_copies, current_memories, current_sessions, ended_at, served_kind

#: Characters of a carried summary.
SUMMARY = 240


def newest_activity(sessions: DataFrame, chats: DataFrame) -> DataFrame:
    """``native_id, project_id, id``: for each chat being written (``native_id, project_id``) the session of its project that ended last, other than its own; the smallest id of equals. Sessions without any time never come last."""
    s = current_sessions(sessions).where(served_kind()).select("id", "project_id", F.col("native_id").alias("other"), ended_at().alias("at")).where("at is not null")
    # the two newest chats of a project are enough: one of them is another than the writer's
    per = s.groupBy("project_id", "other").agg(F.max(F.struct("at", (-F.col("id")).alias("neg"))).alias("x"))
    two = per.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("x"), "other"))).where("n <= 2")
    found = chats.join(two, "project_id").where("native_id <> other")
    return found.groupBy("native_id", "project_id").agg(F.max("x").alias("x")).select("native_id", "project_id", (-F.col("x.neg")).alias("id"))


def first_interactions(memories: DataFrame, turns: DataFrame, version: int) -> DataFrame:
    """``session_id, id, reason``: each session's first turn and why its stored copy may not be shown, the first reason that holds; null where it may.

    ``not_first``: the chat's start is not stored; ``missing``, ``excluded``,
    ``outdated`` (another filter version), ``superseded`` (captured before the
    turn was ingested again), ``truncated``, ``blank``.
    """
    m = current_memories(memories).where("session_id is not null")
    first = m.groupBy("session_id").agg(F.min(F.struct("turn_index", "id", "reingested_at")).alias("x")).select("session_id", "x.*")
    c = current_copies(turns).select(F.col("memory_id").alias("id"), "included", "filter_version", "captured_at", "omitted_before_chars", "user_prompt", "assistant_response", F.lit(True).alias("held"))
    older = F.col("reingested_at").isNotNull() & F.coalesce(F.col("captured_at") < F.col("reingested_at"), F.lit(True))
    reason = (F.when(F.col("turn_index") > 0, "not_first").when(F.col("held").isNull(), "missing").when(~F.coalesce("included", F.lit(False)), "excluded").when(~F.col("filter_version").eqNullSafe(F.lit(version)), "outdated")
              .when(older, "superseded").when(F.coalesce("omitted_before_chars", F.lit(0)) > 0, "truncated").when(E.blank("user_prompt") | E.blank("assistant_response"), "blank"))
    return first.join(c, "id", "left").select("session_id", "id", reason.alias("reason"))


def recall_fields(memories: DataFrame) -> DataFrame:
    """``id, fields``: the strings of each turn that recall looks into: decisions with their reasons, open items, files; nulls and blanks left out."""
    d = F.coalesce("decisions", F.array().cast("array<struct<what:string,why:string>>"))
    none = F.array().cast("array<string>")
    every = F.concat(F.flatten(F.transform(d, lambda x: F.array(x["what"], x["why"]))), F.coalesce("pending_items", none), F.coalesce("files_touched", none))
    return current_memories(memories).select("id", F.filter(every, lambda x: ~E.blank(x)).alias("fields"))


def capsules(sessions: DataFrame, memories: DataFrame, title_bytes: int = 200) -> DataFrame:
    """``id, title, through, newer``: a session's newest metadata: its title unless it is too long, the turn its summary goes up to, and how many turns are newer."""
    m = current_memories(memories).where("session_id is not null")
    per = m.groupBy(F.col("session_id").alias("id")).agg(F.max(F.when(F.col("summarizer_status") == "ok", F.col("turn_index"))).alias("through"), F.count("*").alias("turns"))
    newer = m.select(F.col("session_id").alias("id"), "turn_index").join(per.select("id", "through"), "id").groupBy("id").agg(F.count_if(F.col("turn_index") > F.coalesce("through", F.lit(-1))).alias("newer"))
    s = current_sessions(sessions).select("id", E.byte_guarded(F.coalesce("custom_title", "title"), title_bytes).alias("title"))
    return s.join(per.select("id", "through"), "id", "left").join(newer, "id", "left").select("id", "title", "through", F.coalesce("newer", F.lit(0)).alias("newer"))


def shown_lists(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """``project_id, n, id``: the numbers by which a project's listed sessions are resumed, newest first."""
    s = current_sessions(sessions).where(served_kind()).withColumn("at", ended_at())
    n = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc_nulls_last("at"), F.desc("id")))
    return s.withColumn("n", n).where(F.col("n") <= limit).select("project_id", "n", "id")


def bounded_notes(notes: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """``session_id, key, kept``: which decisions a carried rollup keeps: its summary is cut to ``SUMMARY`` characters, then the oldest decisions give way until all fit ``limit`` characters."""
    size = F.length("what") + F.coalesce(F.length("why"), F.lit(0))
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_index"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    n = notes.withColumn("used", F.sum(size).over(w)).join(summaries.select("session_id", F.least(F.lit(SUMMARY), F.coalesce(F.length("summary"), F.lit(0))).alias("head")), "session_id", "left")
    return n.select("session_id", "key", (F.col("used") + F.coalesce("head", F.lit(0)) <= limit).alias("kept"))


def resume_markers(records: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Boundaries with ``marked``: whether a marker stands since the boundary before; a marker counts for the next boundary only. ``records`` has ``boundary`` and ``marker``."""
    w = Window.partitionBy(file).orderBy(*order)
    # records up to and with a boundary belong to it
    r = records.withColumn("_of", F.coalesce(F.sum(F.col("boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = F.max("marker").over(w.partitionBy(file, "_of").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("marked", seen).where("boundary").drop("_of")

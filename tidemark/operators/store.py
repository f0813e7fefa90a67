"""The store read as tables: current rows, served sessions, lookups along a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E


#: What a session's stored content may cover.
BUCKETS = ("complete", "complete_truncated", "incomplete", "evicted", "never")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def current_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session id, the one ingested last. Rows without id are left out."""
    return first_by(sessions.where("id is not null"), ["id"], [F.desc_nulls_last("last_ingested_at")])


def current_memories(memories: DataFrame) -> DataFrame:
    """Of the rows at one (session_id, turn_index), the one ingested again last (never is earliest), then of the largest id."""
    return first_by(memories.where("id is not null"), ["session_id", "turn_index"], [F.desc_nulls_last("reingested_at"), F.desc("id")])


def current_copies(turns: DataFrame) -> DataFrame:
    """One stored copy per memory: of the newest filter version, then captured last."""
    return first_by(turns.where("memory_id is not null"), ["memory_id"], [F.desc_nulls_last("filter_version"), F.desc_nulls_last("captured_at"), F.desc_nulls_last("user_prompt")])


def ended_at() -> Column:
    return F.coalesce("last_turn_at", "last_ingested_at", "started_at")


def served_kind() -> Column:
    """Sessions that are served: any kind, or none, but the adjudicator's."""
    return ~F.coalesce(F.col("kind"), F.lit("")).eqNullSafe("adjudicator")


def served_sessions(sessions: DataFrame, memories: DataFrame, rolled_up: DataFrame, open_turns: DataFrame) -> DataFrame:
    """Served sessions with what a list shows of each.

    ``rolled_up`` has ``id, notes``, the sessions with a rollup and how many
    decisions and instructions it holds, ``open_turns`` the ``id`` of sessions
    with a staged open turn. Memories are summed up per session before the join,
    so nothing multiplies. ``substantive``: an open turn; else with a rollup its
    notes or a file touched; else two turns or a file touched.
    """
    per = current_memories(memories).groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("turns"), F.sum(F.size("files_touched").cast("bigint")).alias("files"), F.sum(F.size("decisions").cast("bigint")).alias("decisions"))
    s = (current_sessions(sessions).where(served_kind()).join(per, "id", "left").join(rolled_up.select("id", "notes").withColumn("rolled_up", F.lit(True)), "id", "left")
         .join(open_turns.select("id").distinct().withColumn("is_open", F.lit(True)), "id", "left"))
    noted = F.when(F.coalesce("rolled_up", F.lit(False)), F.coalesce("notes", F.lit(0)) > 0).otherwise(F.coalesce("turns", F.lit(0)) >= 2)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return s.select(
        "id", "tool", "native_id", "segment_index", "project_id", F.coalesce("custom_title", "title", F.lit("untitled")).alias("title"), F.coalesce("surface", F.lit("unknown")).alias("surface"),
        ended_at().alias("ended_at"), n("turns").alias("turns"), n("files").alias("files"), (F.coalesce("is_open", F.lit(False)) | noted | (n("files") > 0)).alias("substantive"))


def page(served: DataFrame, before: Column | None = None, tool: str | None = None, limit: int = 20) -> DataFrame:
    """A page of substantive sessions, newest first, with ``has_more``; one row too many is looked at to know."""
    rows = served.where("substantive")
    if tool is not None:
        rows = rows.where(F.col("tool") == tool)
    if before is not None:
        rows = rows.where(F.col("ended_at") < before)
    top = rows.orderBy(F.desc("ended_at"), F.desc("id")).limit(limit + 1)
    w = Window.orderBy(F.desc("ended_at"), F.desc("id"))  # over limit + 1 rows
    return top.withColumn("rank", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("rank") <= limit)


def keyset_page(rows: DataFrame, keys: list[str], after: list, limit: int) -> DataFrame:
    """The next rows behind a composite key, ascending; one more than ``limit`` tells that there is more."""
    beyond, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, after):
        beyond = beyond | (equal & (F.col(k) > F.lit(v)))
        equal = equal & (F.col(k) == F.lit(v))
    return rows.where(beyond).orderBy(*keys).limit(limit + 1)


def project_activity(sessions: DataFrame) -> DataFrame:
    """Per project, tool and surface: sessions, last ingest, and the newest session with its activity."""
    a = current_sessions(sessions).where(served_kind()).withColumn("activity", ended_at())
    newest = F.max(F.struct("activity", "id"))
    return (a.groupBy("project_id", "tool", "surface").agg(F.count("*").alias("sessions"), F.max("last_ingested_at").alias("last_ingested_at"), newest.alias("newest"))
            .select("project_id", "tool", "surface", "sessions", "last_ingested_at", F.col("newest.activity").alias("newest_activity"), F.col("newest.id").alias("newest_id")))


def latest_segments(sessions: DataFrame) -> DataFrame:
    """The last segment of each native chat, its number of segments and whether these run from 0 without a gap."""
    s = current_sessions(sessions)
    return (s.groupBy("tool", "native_id").agg(F.max(F.struct("segment_index", "id")).alias("last"), F.count("*").alias("segments"), F.min("segment_index").alias("first"), F.countDistinct("segment_index").alias("n"))
            .select("tool", "native_id", F.col("last.segment_index").alias("segment_index"), F.col("last.id").alias("session_id"), "segments",
                    ((F.col("first") == 0) & (F.col("last.segment_index") + 1 == F.col("n"))).alias("whole")))


def predecessors(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each turn the turn before it in its native chat, across segments, and the hours between (never below 0)."""
    s = current_sessions(sessions).select(F.col("id").alias("session_id"), "tool", "native_id", "segment_index")
    m = current_memories(memories).select("id", "session_id", "turn_index", "turn_started_at").join(s, "session_id")
    w = Window.partitionBy("tool", "native_id").orderBy("segment_index", "turn_index", "id")
    hours = (F.unix_micros(F.col("turn_started_at").cast("timestamp")) - F.unix_micros(F.lag("turn_started_at").over(w).cast("timestamp"))) / 3.6e9
    return m.select("id", F.lag("id").over(w).alias("previous_id"), F.round(F.coalesce(F.greatest(F.lit(0.0), hours), F.lit(0.0)), 6).alias("gap_hours"))


def chat_before(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per reporting turn, how many turns of its native chat stand at or before it and from how many segments."""
    s = current_sessions(sessions).select(F.col("id").alias("session_id"), "tool", "native_id", "segment_index")
    m = current_memories(memories).select("id", "session_id", "turn_index").join(s, "session_id")
    w = Window.partitionBy("tool", "native_id").orderBy("segment_index", "turn_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("id", F.count("*").over(w).alias("turns_so_far"), F.max("segment_index").over(w).alias("segment_index"))


def copy_state(memories: DataFrame, turns: DataFrame, version: int) -> DataFrame:
    """Per memory whether its stored copy is ``current``, ``outdated`` (of another filter version), ``superseded`` (captured before the turn was ingested again) or ``missing``, and what a search index would hold of it."""
    c = current_copies(turns).select(F.col("memory_id").alias("id"), "included", "omitted_before_chars", "filter_version", "captured_at", F.lit(True).alias("held"))
    m = current_memories(memories).select("id", "session_id", "reingested_at")
    older = F.col("reingested_at").isNotNull() & F.coalesce(F.col("captured_at") < F.col("reingested_at"), F.lit(True))
    state = F.when(F.col("held").isNull(), "missing").when(~F.col("filter_version").eqNullSafe(F.lit(version)), "outdated").when(older, "superseded").otherwise("current")
    coverage = F.when(~F.coalesce("included", F.lit(False)), "excluded").when(F.coalesce("omitted_before_chars", F.lit(0)) > 0, "truncated").otherwise("included")
    return m.join(c, "id", "left").select("id", "session_id", state.alias("state"), coverage.alias("coverage"))


def capture_states(states: DataFrame, failed: DataFrame) -> DataFrame:
    """Per session what its capture has come to: ``parse_error`` where parsing ``failed`` (``session_id``), ``disabled_gap`` with any copy that is not current, ``complete_truncated``, ``complete``."""
    g = states.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(F.col("state") != "current").alias("gaps"), F.count_if(F.col("state") != "missing").alias("held"), F.count_if(F.col("coverage") == "truncated").alias("truncated"))
    bad = failed.select("session_id").distinct().withColumn("bad", F.lit(True))
    state = F.when(F.col("bad"), "parse_error").when(F.col("gaps") > 0, "disabled_gap").when(F.col("truncated") > 0, "complete_truncated").otherwise("complete")
    return g.join(bad, "session_id", "left").select("session_id", "turns", "gaps", "held", state.alias("state"))


def session_coverage(captures: DataFrame, evicted: DataFrame) -> DataFrame:
    """Per session, in order of precedence: ``complete`` or ``complete_truncated`` while all copies are current, ``evicted`` (``session_id``), ``incomplete`` with some copy, ``never`` captured."""
    gone = evicted.select("session_id").distinct().withColumn("gone", F.lit(True))
    bucket = (F.when(F.col("gone"), "evicted").when(F.col("state").isin("complete", "complete_truncated") & (F.col("gaps") == 0), F.col("state"))
              .when(F.col("held") > 0, "incomplete").otherwise("never"))
    return captures.join(gone, "session_id", "left").select("session_id", "turns", bucket.alias("bucket"))


def has_real_content(untitled: str = "untitled") -> Column:
    """Whether a session shows work: an own title, or a title other than that of an untitled one."""
    return (~E.blank("custom_title")) | (~E.blank("title") & (E.trimmed("title") != untitled))


def recall_candidates(sessions: DataFrame, command: str, newest: int | None = None) -> DataFrame:
    """Sessions that may be recalled, newest first with their ``rank``: served ones, without those that hold nothing but a command (``command`` begins a title or the first prompt and there is no real title). ``newest`` is the recency cap, where one is wanted."""
    starts = lambda c: F.coalesce(F.startswith(F.lower(F.ltrim(F.col(c))), F.lit(command)), F.lit(False))
    only = ~has_real_content() & (starts("custom_title") | starts("title") | starts("first_prompt_search"))
    rows = current_sessions(sessions).where(served_kind() & ~only).withColumn("ended_at", ended_at())
    if newest is not None:
        rows = rows.orderBy(F.desc("ended_at"), F.asc("id")).limit(newest)
    return rows


def recall_coverage(candidates: DataFrame, searched: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row that says what a search has covered: projects and sessions in all, those searched (with an indexed first prompt, among ``searched``), sessions by content coverage, and whether absence is conclusive."""
    s = searched.select("id", F.lit(True).alias("seen"))
    c = candidates.join(s, "id", "left").join(coverage.select(F.col("session_id").alias("id"), "bucket"), "id", "left")
    ok = F.coalesce("seen", F.lit(False)) & F.col("first_prompt_search").isNotNull()
    per = c.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("k"), *[F.count_if(F.coalesce("bucket", F.lit("never")) == b).alias(b) for b in BUCKETS], F.count_if(F.coalesce("seen", F.lit(False)) & F.col("first_prompt_search").isNull()).alias("unindexed"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    out = per.agg(F.count("*").alias("projects"), F.count_if(F.col("n") == F.col("k")).alias("projects_searched"), F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("k"), F.lit(0)).alias("sessions_searched"), *[total(b) for b in BUCKETS], total("unindexed"))
    return out.withColumn("conclusive", (F.col("sessions") == F.col("sessions_searched")) & (F.col("sessions") == F.col("complete")))


def first_prompts(memories: DataFrame, turns: DataFrame) -> DataFrame:
    """Per session the document of its first stored prompt; sessions whose prompts are all blank have none."""
    c = current_copies(turns).where(~E.blank("user_prompt")).select(F.col("memory_id").alias("id"), "user_prompt")
    m = current_memories(memories).select("id", "session_id", "turn_index").join(c, "id")
    first = m.groupBy("session_id").agg(F.min(F.struct("turn_index", "id", "user_prompt")).alias("x"))
    return first.select("session_id", F.col("x.turn_index").alias("turn_index"), E.first_prompt_document("x.user_prompt").alias("document"))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the rows of ``changes`` in place of those with equal keys, other rows added."""
    return target.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the target does not hold yet, one per key."""
    return rows.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti")


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key; what an eviction keeps."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")

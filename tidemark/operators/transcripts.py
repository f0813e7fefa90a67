"""What a transcript tells beyond its turns: kinds, titles, lifecycle, open tool calls, pages of changed sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E

#: Lifecycle signals and the state they lead to.
SIGNALS = {"task_started": "started", "task_complete": "finished", "turn_aborted": "aborted", "error": "failed", "stream_error": "failed"}


def surface(entrypoint: Column) -> Column:
    """``cli``, ``desktop`` or null from what started the tool."""
    e = F.lower(entrypoint)
    return F.when(e.rlike("desktop|app|vscode|ide"), "desktop").when(e.rlike("cli|exec|tui|terminal|sdk"), "cli")


def session_kind(thread_source: Column, forked_from: Column, sidechain: Column) -> Column:
    """``subagent``, ``fork-copy`` or ``primary`` from the first record of a session."""
    return F.when(F.coalesce(sidechain, F.lit(False)) | (F.coalesce(thread_source, F.lit("")) == "subagent"), "subagent").when(forked_from.isNotNull(), "fork-copy").otherwise("primary")


def lifecycle(records: DataFrame) -> DataFrame:
    """Per file the state of its last turn: ``none``, ``started``, ``finished``, ``failed`` or ``aborted``; a new start after a failure is a retry and counts."""
    state = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])[F.col("signal")]
    s = records.withColumn("state", state).where("state is not null")
    return s.groupBy("file").agg(F.max_by("state", "pos").alias("state"), F.count_if(F.col("state") == "failed").alias("failures"), F.count_if(F.col("state") == "started").alias("starts"))


def open_calls(records: DataFrame) -> DataFrame:
    """``file, open``: tool calls whose last event is their use, not their result."""
    c = records.where("call_id is not null").groupBy("file", "call_id").agg(F.max(F.struct("pos", "kind")).alias("last"))
    return c.where("last.kind = 'use'").groupBy("file").agg(F.sort_array(F.collect_set("call_id")).alias("open"))


def closable(turns: DataFrame, states: DataFrame, calls: DataFrame, file: str = "file") -> DataFrame:
    """Turns that may be given out: all but a file's last, and that one if it was aborted, or has an answer, no open call and no unfinished lifecycle."""
    last = F.col("turn_index") == F.max("turn_index").over(Window.partitionBy(file))
    t = turns.withColumn("_last", last).join(states.select(file, "state"), file, "left").join(calls, file, "left")
    ready = (F.col("state") == "aborted") | ((F.col("assistant_text") != "") & (F.size(F.coalesce("open", F.array())) == 0) & F.coalesce(F.col("state").isin("finished"), F.lit(True)))
    return t.where(~F.col("_last") | F.coalesce(ready, F.lit(False))).drop("_last", "state", "open")


def last_title(records: DataFrame, file: str = "file") -> DataFrame:
    """The last title event of each file; blank titles do not count."""
    return records.where(~E.blank("title")).groupBy(file).agg(F.max_by(E.trimmed("title"), "pos").alias("title"))


def indexed_titles(index: DataFrame) -> DataFrame:
    """Titles from a side index: the latest update wins, the later row of equals; rows without a time only where there is no other."""
    return index.groupBy("native_id").agg(F.max(F.struct(F.col("updated_at").isNotNull().alias("known"), "updated_at", "pos", "title")).alias("x")).select("native_id", F.col("x.title").alias("title"))


def turn_opener(records: DataFrame) -> DataFrame:
    """Which record type opens turns in each file: that of the first deciding record; ``response_item`` where none decides."""
    d = F.when((F.col("type") == "event_msg") & (F.col("sub") == "user_message"), "event_msg").when((F.col("type") == "response_item") & (F.col("role") == "assistant"), "response_item")
    return records.withColumn("d", d).groupBy("file").agg(F.coalesce(F.min_by("d", F.when(F.col("d").isNotNull(), F.col("pos"))), F.lit("response_item")).alias("opener"))


def messages_with_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of a relational source with their text parts joined in order; a message without parts keeps an empty text."""
    p = parts.where("type = 'text'").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return messages.join(p, messages["id"] == p["message_id"], "left").select(messages["*"], F.coalesce("text", F.lit("")).alias("text"))


def dirty_sessions(sessions: DataFrame, watermark, cursor_id, handled: DataFrame, limit: int) -> DataFrame:
    """Sessions changed behind a (time, id) cursor that are not handled elsewhere, oldest first; one more than ``limit`` tells that there is more."""
    beyond = (F.col("time_updated") > F.lit(watermark)) | ((F.col("time_updated") == F.lit(watermark)) & (F.col("id") > F.lit(cursor_id)))
    return sessions.where(beyond).join(handled.select("id"), "id", "left_anti").orderBy("time_updated", "id").limit(limit + 1)


def with_retries(page: DataFrame, pending: DataFrame, limit: int = 32) -> DataFrame:
    """A page of changed sessions and up to ``limit`` pending retries that it does not hold."""
    retry = pending.join(page.select("id"), "id", "left_anti").orderBy("rank", "id").limit(limit).select("id")
    return page.select("id", F.lit(False).alias("retry")).unionByName(retry.withColumn("retry", F.lit(True)))


def without_own_output(turns: DataFrame, mark: str, *texts: str) -> DataFrame:
    """Turns in none of whose texts the system's own mark stands."""
    return turns.where(~F.coalesce(F.contains(F.concat_ws("\n", *texts), F.lit(mark)), F.lit(False)))


def staged_open_turns(observed: DataFrame, sources: DataFrame, closed: DataFrame, now: Column, grace_minutes: int = 5) -> DataFrame:
    """``session_id, staged_at, state``: open turns seen at a file's failed end (``session_id, source_id, at``), the last sighting of each session.

    ``closed`` where a turn of the session closed since (``session_id, at``),
    ``invalid`` where the file is another now (``session_id, source_id``) or
    gone, ``waiting`` within the grace, else ``open``.
    """
    last = observed.groupBy("session_id").agg(F.max(F.struct("at", "source_id")).alias("x")).select("session_id", F.col("x.at").alias("staged_at"), F.col("x.source_id").alias("source_id"))
    is_now = sources.groupBy("session_id").agg(F.max("source_id").alias("is_now"))
    done = closed.groupBy("session_id").agg(F.max("at").alias("done"))
    state = (F.when(F.col("done") >= F.col("staged_at"), "closed").when(~F.col("source_id").eqNullSafe(F.col("is_now")), "invalid")
             .when(F.col("staged_at") + F.expr(f"interval {int(grace_minutes)} minutes") > now, "waiting").otherwise("open"))
    return last.join(is_now, "session_id", "left").join(done, "session_id", "left").select("session_id", "staged_at", state.alias("state"))


def compact_summaries(records: DataFrame, limit: int) -> DataFrame:
    """``file, state, summary``: the summary that stands for what a file held before its last compaction.

    ``records`` has ``file, pos, compacted`` (a compaction ends here) and
    ``summary``. Only summaries since the last compaction count: ``none``,
    ``blank``, ``oversize`` (over ``limit`` characters), ``ambiguous`` (several
    texts), else ``found``.
    """
    last = records.groupBy("file").agg(F.max(F.when(F.col("compacted"), F.col("pos"))).alias("since"))
    tail = records.join(last, "file").where(F.col("summary").isNotNull() & (F.col("pos") >= F.coalesce("since", F.lit(0))))
    g = tail.groupBy("file").agg(F.countDistinct("summary").alias("n"), F.min("summary").alias("summary"))
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").when(E.blank("summary"), "blank").when(F.length("summary") > limit, "oversize").otherwise("found")
    return last.join(g, "file", "left").select("file", state.alias("state"), F.when(state == "found", F.col("summary")).alias("summary"))

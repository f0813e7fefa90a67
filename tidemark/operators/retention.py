"""What cleanup may take, what it takes, when usage is warned of, and which stored chats have lost their place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import oldest_first

#: Bytes of the ledger from which a write needs cleanup, from which usage is warned of weekly and at every opening, and down to which cleanup goes.
CAPACITY, WARNING, URGENT, TARGET = 5_000_000_000, 4_000_000_000, 4_750_000_000, 4_750_000_000
#: Hours in which a chat counts as being written, and between two warnings.
ACTIVE_HOURS, WARNING_HOURS = 24, 7 * 24
#: Capture states in which a session's text is stored in full.
COMPLETE = ("complete", "complete_truncated", "evicted")
CHAT = ["tool", "native_id"]


def referenced_parents(sessions: DataFrame, parents: DataFrame) -> DataFrame:
    """``tool, native_id`` of chats of which a session is the parent (``session_id, parent_id``) of another chat's session."""
    child = sessions.select(F.col("id").alias("session_id"), F.struct(*CHAT).alias("child"))
    parent = sessions.select(F.col("id").alias("parent_id"), *CHAT)
    return parents.join(child, "session_id").join(parent, "parent_id").where(F.col("child") != F.struct(*CHAT)).select(*CHAT).distinct()


def eligibility(sessions: DataFrame, captures: DataFrame, open_turns: DataFrame, projects: DataFrame, consents: DataFrame, referenced: DataFrame, now: Column, writing: tuple[str, str] | None = None) -> DataFrame:
    """``tool, native_id, ineligible``: per native chat why cleanup must not take it, or null.

    In this order: ``active_writer`` (the chat whose write asks for room),
    ``open_turn`` (``tool, native_id``), ``capture_incomplete`` (a session whose
    state, ``session_id, state``, is none of the complete ones),
    ``identity_uncertain`` (no time of ingest, an unknown project, or parent of
    another chat), ``active_writer`` (ingested within a day), ``consent_unsettled``
    (a project path, ``path, state``, still pending).
    """
    p = projects.select(F.col("id").alias("project_id"), "path")
    s = (sessions.join(captures.select(F.col("session_id").alias("id"), F.col("state").alias("capture")), "id", "left").join(p, "project_id", "left").join(consents.select("path", F.col("state").alias("consent")), "path", "left"))
    per = s.groupBy(*CHAT).agg(
        F.max((~F.coalesce(F.col("capture").isin(*COMPLETE), F.lit(False)))).alias("gap"), F.max(F.col("path").isNull()).alias("homeless"), F.max(F.col("last_ingested_at").isNull()).alias("untimed"),
        F.max("last_ingested_at").alias("ingested"), F.max(F.col("path").isNotNull() & (F.coalesce("consent", F.lit("pending")) == "pending")).alias("pending"))
    mark = lambda df, name: df.select(*CHAT).distinct().withColumn(name, F.lit(True))
    per = per.join(mark(open_turns, "is_open"), CHAT, "left").join(mark(referenced, "is_parent"), CHAT, "left")
    own = (F.col("tool") == F.lit(writing[0])) & (F.col("native_id") == F.lit(writing[1])) if writing else F.lit(False)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ingested").cast("timestamp"))
    reason = (F.when(own, "active_writer").when(F.col("is_open"), "open_turn").when(F.col("gap"), "capture_incomplete")
              .when(F.col("untimed") | F.col("homeless") | F.coalesce("is_parent", F.lit(False)), "identity_uncertain").when(age < ACTIVE_HOURS * 3_600_000_000, "active_writer").when(F.col("pending"), "consent_unsettled"))
    return per.select(*CHAT, reason.alias("ineligible"))


def plan(units: DataFrame, eligible: DataFrame, stored: int, before: int, write: int, capacity: int = CAPACITY, warning: int = WARNING, target: int = TARGET) -> tuple[str, DataFrame]:
    """What becomes of a write, and the chats (``tool, native_id, bytes, before``) that cleanup takes for it.

    ``within_capacity`` needs none. ``unwarned_jump``: usage before was below the
    warning, so none may follow. ``target_unreachable``: all eligible chats are
    too few. ``cleanup``: the smallest oldest-first prefix of eligible chats that
    brings what is stored, with the write, to the target.
    """
    free = units.join(eligible.where("ineligible is null").select(*CHAT), CHAT)
    required = stored + write - target
    taken = oldest_first(free, required)
    if before + write < capacity:
        return "within_capacity", taken.limit(0)
    if before < warning:
        return "unwarned_jump", taken.limit(0)
    if (free.agg(F.sum("bytes")).first()[0] or 0) < required:
        return "target_unreachable", taken.limit(0)
    return "cleanup", taken


def warnings(observed: DataFrame, key: str, at: str, used: str, warning: int = WARNING, urgent: int = URGENT, hours: int = WARNING_HOURS) -> DataFrame:
    """``observed`` with ``due``: ``urgent`` at every opening from the urgent band on, ``weekly`` once per interval from the warning on, else null; a lower reading starts the interval anew.

    When a warning is due depends on when the last one was, so readings of a key
    are walked in order; a key's state is one time.
    """
    schema = observed.schema
    names = observed.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), None
        for part in batches:
            due = []
            for k, t, u in zip(*(part.column(names.index(c)).to_pylist() for c in (key, at, used))):
                if k != current:
                    current, last = k, None
                kind = None
                if u is None or u < warning:
                    last = None
                elif u >= urgent:
                    kind, last = "urgent", t
                elif last is None or (t - last).total_seconds() >= hours * 3600:
                    kind, last = "weekly", t
                due.append(kind)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(due, pa.string())], names=[*names, "due"])

    return observed.where(F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at, used).mapInArrow(walk, schema.add("due", "string"))


def orphans(sessions: DataFrame, projects: DataFrame, observed: DataFrame, sources: DataFrame, protected: DataFrame) -> DataFrame:
    """``tool, native_id, outcome``: whether a native chat still has its place.

    ``observed`` and ``sources`` say of project and source paths (``path, state``)
    whether they are a ``directory`` or ``file``, ``missing`` or ``unresolved``.
    A segment is ``associated`` where its project's path is there; where it is
    missing, ``relocated`` if the recorded root is there, else ``candidate``;
    ``unresolved`` where anything could not be seen or the project is unknown.
    Segments of one chat with different sources are unresolved. The strongest of
    unresolved, relocated, associated counts; a chat with candidates beside, or
    of several projects, is ``mixed``. An unprotected (``tool, native_id``) chat
    whose place is there but whose source is missing is a candidate too.
    """
    look = lambda df, path, name: df.select(F.col("path").alias(path), F.col("state").alias(name))
    p = projects.select(F.col("id").alias("project_id"), F.col("path").alias("home"), "git_root").join(look(observed, "home", "at_home"), "home", "left").join(look(observed, "git_root", "at_root"), "git_root", "left")
    root = F.when(F.col("git_root").isNull() | (F.col("git_root") == F.col("home")), "missing").otherwise(F.coalesce("at_root", F.lit("unresolved")))
    one = (F.when(F.col("at_home") == "directory", "associated").when(F.col("at_home") == "missing", F.when(root == "missing", "candidate").when(root == "directory", "relocated").otherwise("unresolved")).otherwise("unresolved"))
    s = sessions.join(p.select("project_id", one.alias("one")), "project_id", "left").withColumn("one", F.coalesce("one", F.lit("unresolved")))
    has = lambda x: F.max(F.col("one") == x).alias(x)
    g = s.groupBy(*CHAT).agg(*[has(x) for x in ("unresolved", "relocated", "associated", "candidate")], F.countDistinct("project_id").alias("owners"), (F.countDistinct("source_path") + F.max(F.col("source_path").isNull().cast("int"))).alias("origins"), F.min("source_path").alias("source"))
    strongest = F.when(F.col("origins") != 1, "unresolved").when(F.col("unresolved"), "unresolved").when(F.col("relocated"), "relocated").when(F.col("associated"), "associated").otherwise("candidate")
    g = g.withColumn("first", strongest)
    mixed = (F.col("first") != "candidate") & ((F.col("candidate") & (F.col("origins") == 1)) | (F.col("owners") > 1))
    g = (g.withColumn("first", F.when(mixed, "mixed").otherwise(F.col("first"))).join(look(sources, "source", "at_source"), "source", "left")
         .join(protected.select(*CHAT).distinct().withColumn("kept", F.lit(True)), CHAT, "left"))
    placed = F.col("first").isin("associated", "relocated") & F.col("kept").isNull()
    return g.select(*CHAT, F.when(placed & (F.col("at_source") == "missing"), "candidate").when(placed & F.coalesce(F.col("at_source") == "unresolved", F.lit(True)), "unresolved").otherwise(F.col("first")).alias("outcome"))

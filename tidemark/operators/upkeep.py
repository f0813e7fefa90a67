"""Keeping the store: matching on import, ownership, requests and receipts, embedding passes, rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.projects import _set

#: Rules of one owner, their characters together, and of one.
RULES, RULES_CHARS, RULE_CHARS = 8, 1200, 300


def identity_ranks(projects: DataFrame) -> DataFrame:
    """``id, rank, key``: what a project may be known by, the surest first: remote, first commit, root, path."""
    keys = [F.struct(F.lit(n).alias("rank"), k.alias("key")) for n, k in enumerate((_set("git_remote"), _set("git_root_commit"), _set("git_root"), F.col("path")), 1)]
    return projects.select("id", F.inline(F.array(*keys))).where("key is not null")


def import_matches(backup: DataFrame, local: DataFrame) -> DataFrame:
    """``id, rank, local_id, state``: the local project of each project of a backup, by the surest key that any shares; ``ambiguous`` (with the smallest id) where several do, ``unmatched`` without any."""
    hits = identity_ranks(backup).join(identity_ranks(local).withColumnRenamed("id", "local_id"), ["rank", "key"]).where("id <> local_id or id is null")
    best = hits.groupBy("id", "rank").agg(F.min("local_id").alias("local_id"), F.countDistinct("local_id").alias("n")).groupBy("id").agg(F.min(F.struct("rank", "local_id", "n")).alias("x"))
    state = F.when(F.col("x").isNull(), "unmatched").when(F.col("x.n") > 1, "ambiguous").otherwise("matched")
    return backup.select("id").distinct().join(best, "id", "left").select("id", F.col("x.rank").alias("rank"), F.col("x.local_id").alias("local_id"), state.alias("state"))


def rekeyed(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rows whose owner in ``column`` is rewritten by ``mapping`` (``old, new``); owners it does not name stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def upsert_projects(projects: DataFrame, seen: DataFrame) -> DataFrame:
    """``key, first_seen_at, last_seen_at, known``: projects by root, else path, touched by what was seen (``path, git_root, at``); unknown ones are added."""
    key = F.coalesce(_set("git_root"), F.col("path"))
    old = projects.select(key.alias("key"), "first_seen_at", "last_seen_at", F.lit(True).alias("known"))
    new = seen.select(key.alias("key"), F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.lit(False).alias("known"))
    g = old.unionByName(new).where("key is not null").groupBy("key")
    return g.agg(F.coalesce(F.min(F.when(F.col("known"), F.col("first_seen_at"))), F.min("first_seen_at")).alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("known").alias("known"))


def outcomes(stored: DataFrame, incoming: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``keys, outcome`` of what comes in: ``stored`` where the key is new, ``duplicate`` with the same body (null equals null), ``conflict`` with another, or where the same key comes with several."""
    old = stored.groupBy(*keys).agg(F.min(F.struct(body)).alias("was"))
    new = incoming.groupBy(*keys).agg(F.min(F.struct(body)).alias("is"), F.max(F.struct(body)).alias("also"))
    j = new.join(old, keys, "left")
    outcome = F.when(F.col("is") != F.col("also"), "conflict").when(F.col("was").isNull(), "stored").when(F.col("is").eqNullSafe(F.col("was")), "duplicate").otherwise("conflict")
    return j.select(*keys, outcome.alias("outcome"))


def consumed(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """``request_id, attempt_id``: who consumes each request (``request_id, issued_at``): the first attempt (``attempt_id, request_id, at``) since it was issued, the smallest id of equals; later ones find it consumed."""
    j = requests.join(attempts, "request_id").where(F.col("at") >= F.col("issued_at"))
    return j.groupBy("request_id").agg(F.min(F.struct("at", "attempt_id")).alias("x")).select("request_id", F.col("x.attempt_id").alias("attempt_id"))


def rebuilds(sessions: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """``id, reason`` of sessions whose rollup (``id, version``) is ``missing`` or ``outdated``."""
    j = sessions.select("id").distinct().join(versions.select("id", "version"), "id", "left")
    reason = F.when(F.col("version").isNull(), "missing").when(F.col("version") != version, "outdated")
    return j.select("id", reason.alias("reason")).where("reason is not null")


def embedding_pass(sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, status``: what an embedding pass has to do for each source (``id, source, source_hash, project_id``): ``ineligible`` without text, ``missing`` without a vector, ``moved`` with one of another project, ``changed`` with one of another text, else ``current``."""
    v = vectors.select(F.col("session_id").alias("id"), F.col("source_hash").alias("was"), F.col("project_id").alias("owner"), F.lit(True).alias("has"))
    status = (F.when(E.blank("source"), "ineligible").when(F.col("has").isNull(), "missing").when(~F.col("owner").eqNullSafe(F.col("project_id")), "moved").when(~F.col("was").eqNullSafe(F.col("source_hash")), "changed").otherwise("current"))
    return sources.join(v, "id", "left").select("id", status.alias("status"))


def owned_vectors(vectors: DataFrame, sessions: DataFrame) -> DataFrame:
    """Vectors whose session is stored and belongs to the same project as when they were computed."""
    return vectors.join(sessions.select(F.col("id").alias("session_id"), "project_id"), ["session_id", "project_id"], "left_semi")


def turn_offsets(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """``tool, native_id, offset``: where the turns of a chat that goes on elsewhere are to be numbered from."""
    s = sessions.select(F.col("id").alias("session_id"), "tool", "native_id")
    return memories.drop("tool").join(s, "session_id").groupBy("tool", "native_id").agg((F.max("turn_index") + 1).alias("offset"))


def restored(backup: DataFrame, *tombstones: DataFrame) -> DataFrame:
    """Rows of a backup as they may come back: what tombstones of today name (``tool, native_id``) stays away."""
    for t in tombstones:
        backup = backup.join(t.select("tool", "native_id").distinct(), ["tool", "native_id"], "left_anti")
    return backup


def admitted_rules(rules: DataFrame, owner: str, order: str, text: str) -> DataFrame:
    """``rules`` with ``outcome``: ``blank``, ``too_long``, ``duplicate`` of one admitted, ``too_many``, ``over_total`` or ``admitted``.

    Only admitted rules count for what follows, so those of an owner are walked
    in order; what is kept of them are at most ``RULES`` texts.
    """
    names = rules.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        kept: list[str] = []
        for part in batches:
            out = []
            for who, t in zip(part.column(names.index(owner)).to_pylist(), part.column(names.index(text)).to_pylist()):
                if who != current:
                    current, kept = who, []
                t = " ".join((t or "").split())
                if not t:
                    out.append("blank")
                elif len(t) > RULE_CHARS:
                    out.append("too_long")
                elif t in kept:
                    out.append("duplicate")
                elif len(kept) >= RULES:
                    out.append("too_many")
                elif sum(map(len, kept)) + len(t) > RULES_CHARS:
                    out.append("over_total")
                else:
                    kept.append(t)
                    out.append("admitted")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*names, "outcome"])

    return rules.repartition(owner).sortWithinPartitions(owner, order).mapInArrow(walk, rules.schema.add("outcome", "string"))


def removal_report(removed: DataFrame, newest: int = 10) -> DataFrame:
    """The newest removals (``tool, native_id, started_at, bytes``) with how many there are and their bytes in all."""
    total = removed.agg(F.count("*").alias("chats"), F.sum("bytes").alias("all_bytes"))
    return removed.orderBy(F.desc_nulls_last("started_at"), "tool", "native_id").limit(newest).crossJoin(F.broadcast(total))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, with ``same``: how many further rows repeat it and ``other``: how many differ from it in ``body``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_body", F.first("body").over(w))
    g = r.groupBy(*keys).agg(F.min_by("body", "_n").alias("body"), (F.count_if(F.col("body").eqNullSafe(F.col("_body"))) - 1).alias("same"), F.count_if(~F.col("body").eqNullSafe(F.col("_body"))).alias("other"))
    return g

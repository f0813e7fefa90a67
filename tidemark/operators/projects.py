"""Projects: groups of rows that are one project, consent by longest prefix, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.runtime import cut


def _set(c: str):
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def identity() -> F.Column:
    """What a project row is known by: its remote, else its first commit, else its root; rows without any have none."""
    return F.coalesce(F.concat(F.lit("remote:"), _set("git_remote")), F.concat(F.lit("commit:"), _set("git_root_commit")), F.concat(F.lit("root:"), _set("git_root")))


def ancestors(path: str) -> F.Column:
    """All directories above a path and itself, shallowest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def groups(projects: DataFrame) -> DataFrame:
    """``id, group_key``: rows with one identity belong together; rows without one belong to their shallowest stored ancestor.

    Ancestors are looked up by equality on each prefix of the path, so there is
    no comparison of all paths with all.
    """
    known = projects.where(identity().isNotNull()).select("id", identity().alias("group_key"))
    rest = projects.where(identity().isNull() & F.col("path").isNotNull()).select("id", "path")
    up = rest.select("id", F.posexplode(ancestors("path")).alias("depth", "prefix"))
    top = up.join(rest.select(F.col("path").alias("prefix")).distinct(), "prefix").groupBy("id").agg(F.min_by("prefix", "depth").alias("root"))
    return known.unionByName(rest.join(top, "id", "left").select("id", F.concat(F.lit("path:"), F.coalesce("root", "path")).alias("group_key")))


def consent(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``path, state``: the state of the deepest decided root that holds a path; ``pending`` without any.

    A pending root is no decision, so one above it holds. Of roots at one path
    the one from the command line, then decided last, then of the largest id
    counts.
    """
    best = roots.where("state <> 'pending'").withColumn("_rn", F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.col("source") == "cli"), F.desc("decided_at"), F.desc("ulid")))).where("_rn = 1").select("root", "state")
    probe = paths.select(path).distinct()
    up = probe.select(path, F.posexplode(ancestors(path)).alias("depth", "root"))
    found = up.join(best, "root").groupBy(path).agg(F.max_by("state", "depth").alias("state"))
    return probe.join(found, path, "left").select(path, F.coalesce("state", F.lit("pending")).alias("state"))


def components(edges: DataFrame, node: str, key: str) -> DataFrame:
    """Connected components of nodes that share keys: the smallest node of each, by rounds of taking the least.

    Each round halves distances by also following the label's own label; it is
    written out, so rounds do not build on each other's plans.
    """
    e = edges.select(F.col(node).alias("n"), F.col(key).alias("k")).where("n is not null and k is not null").distinct()
    label = e.groupBy("n").agg(F.min("n").alias("l"))
    while True:
        by_key = e.join(label, "n").groupBy("k").agg(F.min("l").alias("l"))
        near = e.join(by_key, "k").groupBy("n").agg(F.min("l").alias("m"))
        up = label.select(F.col("n").alias("m"), F.col("l").alias("ml"))
        new = cut(label.join(near, "n").join(up, "m", "left").select("n", F.least("l", "m", F.coalesce("ml", "m")).alias("nl"), "l"), "components")
        changed = not new.where("nl <> l").isEmpty()
        label = new.select("n", F.col("nl").alias("l"))
        if not changed:
            return label.select(F.col("n").alias(node), F.col("l").alias("component"))


def identity_keys(projects: DataFrame) -> DataFrame:
    """``id, key``: every key a project row may share with others."""
    keys = F.array_compact(F.array(F.concat(F.lit("remote:"), _set("git_remote")), F.concat(F.lit("commit:"), _set("git_root_commit")), F.concat(F.lit("root:"), _set("git_root")), F.concat(F.lit("path:"), F.col("path"))))
    return projects.select("id", F.explode(keys).alias("key"))


def resolve(projects: DataFrame, names: DataFrame) -> DataFrame:
    """``query, rank, id``: projects that a query names, by the best rank that matches anything.

    Ranks: 1 path, 2 git root, 3 remote, 4 name or last part of the path, 5 a part of the path. Several rows at one rank are an ambiguity.
    """
    q = names.where("query is not null").select("query").distinct()
    last = F.lower(F.element_at(F.split("path", "/"), -1))
    keys = [F.struct(F.lit(r).alias("rank"), k.alias("key")) for r, k in ((1, F.col("path")), (2, F.col("git_root")), (3, F.col("git_remote")), (4, F.lower("display_name")), (4, last))]
    p = projects.select("id", F.inline(F.array(*keys))).where("key is not null").distinct()
    asked = q.select("query", F.inline(F.array(*[F.struct(F.lit(r).alias("rank"), (F.lower("query") if r == 4 else F.col("query")).alias("key")) for r in (1, 2, 3, 4)])))
    exact = cut(asked.join(p, ["rank", "key"]).select("query", "rank", "id").distinct(), "named")
    # only what nothing equals is looked for within the paths
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    part = rest.join(projects.where("path is not null").select("id", F.lower("path").alias("low")), F.contains(F.col("low"), F.lower("query"))).select("query", F.lit(5).alias("rank"), "id")
    hits = exact.unionByName(part)
    return hits.withColumn("_best", F.min("rank").over(Window.partitionBy("query"))).where("rank = _best").select("query", "rank", "id")


def canonical(projects: DataFrame) -> DataFrame:
    """``group_key, id``: of each group the row at the shallowest path, then the smallest path and id."""
    g = groups(projects).join(projects.select("id", "path"), "id")
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    return g.groupBy("group_key").agg(F.min(F.struct(depth.alias("d"), "path", "id")).alias("x"), F.count("*").alias("rows")).select("group_key", F.col("x.id").alias("id"), "rows")

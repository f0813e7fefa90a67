"""Segmentation of a log into work segments by time gaps and evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A gap this long cuts by itself; a shorter one than the other never does.
CUT_HOURS, LEAST_HOURS = 168.0, 4.0
#: File overlap that speaks for a new segment, and that vetoes one.
LOW_OVERLAP, HIGH_OVERLAP = 0.2, 0.5
#: Files remembered of a segment, the newest ones.
TRAILING_FILES = 50


def gap_hours(time: str, w) -> F.Column:
    """Hours since the row before, never below 0; 0 where either time is unknown."""
    h = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 3.6e9
    return F.coalesce(F.greatest(F.lit(0.0), h), F.lit(0.0))


def by_gap_and_branch(rows: DataFrame, key: str, time: str, order: list[str], branch: str) -> DataFrame:
    """Segment numbers from gaps and branch changes alone, which need no state: one window pass."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = gap_hours(time, w)
    cut = (F.row_number().over(w) > 1) & ((gap >= CUT_HOURS) | ((gap >= LEAST_HOURS) & ~F.col(branch).eqNullSafe(F.lag(branch).over(w)) & F.col(branch).isNotNull() & F.lag(branch).over(w).isNotNull()))
    return rows.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def assess(gap, trailing_branch, branch, trailing_files, files, marker):
    """Whether a turn begins a new segment.

    A long gap always cuts and a short one never. Between, a high overlap of the
    files vetoes; otherwise a changed branch, a low overlap (unless the branches
    are equal) or a resume marker cuts. Overlap says nothing where a side is empty.
    """
    both = (F.size(trailing_files) > 0) & (F.size(files) > 0)
    overlap = F.when(both, F.size(F.array_intersect(trailing_files, files)) / F.size(F.array_union(trailing_files, files)))
    known = trailing_branch.isNotNull() & branch.isNotNull()
    evidence = (known & (trailing_branch != branch)) | (F.coalesce(overlap < LOW_OVERLAP, F.lit(False)) & ~(known & (trailing_branch == branch))) | F.coalesce(marker, F.lit(False))
    return F.when(gap >= CUT_HOURS, True).when(gap < LEAST_HOURS, False).when(F.coalesce(overlap >= HIGH_OVERLAP, F.lit(False)), False).otherwise(evidence)


def with_state(rows: DataFrame, key: str, time: str, order: list[str], branch: str, files: str, marker: str | None = None) -> DataFrame:
    """Segment numbers by all evidence, whose file memory starts empty at each cut.

    The state depends on the cuts, so rows are walked in order. A gap that cuts
    by itself resets the state: a key is split there first, so that its runs
    are spread over tasks, and each is walked once with a state of constant size.
    """
    w = Window.partitionBy(key).orderBy(*order)
    g = rows.withColumn("_gap", gap_hours(time, w)).withColumn("_n", F.row_number().over(w))
    runs = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_run", F.sum(F.when((F.col("_n") == 1) | (F.col("_gap") >= CUT_HOURS), 1).otherwise(0)).over(runs))
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        segment, trailing, kept = 0, None, []
        for part in batches:
            keys, run, n, gaps, branches, lists, marks = (c.to_pylist() for c in part.columns)
            out = []
            for k, r, gap, b, f, mark in zip(keys, run, gaps, branches, lists, marks):
                f = f or []
                if (k, r) != current:
                    current, segment, trailing, kept = (k, r), 0, b, []
                elif cuts(gap, trailing, b, kept, f, bool(mark)):
                    segment, trailing, kept = segment + 1, b, []
                else:
                    trailing = trailing if b is None else b
                kept = list(dict.fromkeys([*f, *kept]))[:TRAILING_FILES]
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.int32())], names=[key, "_run", "_n", "_seg"])

    slim = g.select(key, "_run", "_n", "_gap", F.col(branch).alias("b"), F.col(files).alias("f"), (F.col(marker) if marker else F.lit(False)).alias("m"))
    folded = slim.repartition(key, "_run").sortWithinPartitions(key, "_run", "_n").mapInArrow(walk, f"`{key}` {kind}, _run bigint, _n int, _seg int")
    # each run continues the numbers of the runs before it
    before = Window.partitionBy(key).orderBy("_run", "_n").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("_seg") != F.lag("_seg").over(Window.partitionBy(key).orderBy("_run", "_n")), F.lit(False)) | (F.coalesce(F.lag("_run").over(Window.partitionBy(key).orderBy("_run", "_n")), F.col("_run")) != F.col("_run"))
    numbered = folded.withColumn("segment", F.sum(fresh.cast("int")).over(before).cast("int")).select(F.col(key).alias("_k"), F.col("_n").alias("_at"), "segment")
    return g.join(numbered, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_at"))).drop("_gap", "_n", "_run", "_k", "_at")


def cuts(gap: float, trailing_branch: str | None, branch: str | None, trailing_files: list[str], files: list[str], marker: bool) -> bool:
    """The rule of :func:`assess` on plain values."""
    if gap >= CUT_HOURS:
        return True
    if gap < LEAST_HOURS:
        return False
    union = {*trailing_files, *files}
    overlap = len({*trailing_files} & {*files}) / len(union) if trailing_files and files else None
    if overlap is not None and overlap >= HIGH_OVERLAP:
        return False
    known = branch is not None and trailing_branch is not None
    return known and branch != trailing_branch or overlap is not None and overlap < LOW_OVERLAP and not (known and branch == trailing_branch) or marker

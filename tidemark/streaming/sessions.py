"""Streams: idempotent upserts, open segments with timeouts, retraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.segments import CUT_HOURS, HIGH_OVERLAP, LEAST_HOURS, LOW_OVERLAP, TRAILING_FILES


#: Parts of an upserted table by the hash of its keys; a batch rewrites those it touches.
PARTS = 64


def upsert_parquet(path: str, keys: list[str], order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: a table that holds, of each key, the row latest by ``order``.

    The table lies in ``parts`` by the hash of the keys. A batch writes a new
    version of the parts it touches and a list of which version of each part
    counts; other parts stay as they are. A repeated batch writes the same again,
    so the effect is exactly once. Readers take an epoch with :func:`latest_version`.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        came = batch.withColumn("_part", part)
        touched = [r[0] for r in came.select("_part").distinct().collect()]  # as many as there are parts at most
        known = _versions(spark, path, epoch - 1)
        old = [f"{path}/data/version={known[p]}/_part={p}" for p in touched if p in known]
        rows = batch
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch)
        if touched:
            last = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *[c for c in batch.columns if c not in keys])).alias("x"))
            (last.select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in batch.columns]).withColumn("_part", part)
             .write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/version={epoch}"))
        known |= dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(known.items()), "part int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/epoch={epoch}")

    return run


def _versions(spark, path: str, epoch: int) -> dict[int, int]:
    """Which version of each part counts after an epoch."""
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version bigint").parquet(f"{path}/versions/epoch={epoch}").collect()} if epoch >= 0 else {}


def latest_version(spark, path: str, epoch: int, schema) -> DataFrame:
    """The upserted table after an epoch."""
    parts = [f"{path}/data/version={v}/_part={p}" for p, v in sorted(_versions(spark, path, epoch).items())]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


OUT = "key string, segment int, turns int, first_at timestamp, last_at timestamp, final boolean"
STATE = "segment int, turns int, first_us bigint, last_us bigint, branch string, files array<string>"


def _segmenter(idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def row(segment, turns, first, last, final):
            out.append((key[0], segment, turns, pd.Timestamp(first, unit="us", tz="UTC"), pd.Timestamp(last, unit="us", tz="UTC"), final))

        if state.hasTimedOut:
            segment, turns, first, last, branch, files = state.get
            row(segment, turns, first, last, True)
            state.update((segment, turns, first, last, branch, files))  # a later turn goes on from here
        else:
            segment, turns, first, last, branch, files = state.get if state.exists else (0, 0, 0, 0, None, [])
            files = list(files)
            rows = pd.concat(list(batches)).sort_values(["at", "turn"], kind="stable")
            for at, b, f in zip(rows["at"], rows["branch"], rows["files"]):
                us = int(at.value // 1000)
                f = [] if f is None else list(f)
                b = None if b is None or b != b else b
                if turns:
                    gap = max(0.0, (us - last) / 3.6e9)
                    union = set(f) | set(files)
                    overlap = len(set(f) & set(files)) / len(union) if f and files else None
                    if gap >= CUT_HOURS:
                        cut = True
                    elif gap < LEAST_HOURS or (overlap is not None and overlap >= HIGH_OVERLAP):
                        cut = False
                    else:
                        known = b is not None and branch is not None
                        cut = known and b != branch or overlap is not None and overlap < LOW_OVERLAP and not (known and b == branch)
                    if cut:
                        row(segment, turns, first, last, True)
                        segment, turns, branch, files = segment + 1, 0, None, []
                first = us if not turns else first
                turns, last, branch = turns + 1, max(last, us) if turns else us, b or branch
                files = list(dict.fromkeys(f + files))[:TRAILING_FILES]
            row(segment, turns, first, last, False)
            state.update((segment, turns, first, last, branch, files))
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "segment", "turns", "first_at", "last_at", "final"])

    return run


def segment_stream(turns: DataFrame, lateness: str = "1 hour", idle_minutes: int = 30) -> DataFrame:
    """Segments of a stream of turns (``key, turn, at, branch, files``) as they grow.

    State per key is the open segment: its counts, last branch and newest files.
    A row with ``final`` false updates a segment; it becomes final when a turn
    cuts, or when the watermark passes its last turn by ``idle_minutes``; a later
    turn may reopen it. Update mode.
    """
    return (turns.withWatermark("at", lateness).groupBy("key")
            .applyInPandasWithState(_segmenter(idle_minutes * 60_000), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout))

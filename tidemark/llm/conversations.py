"""Rebuilding conversations from message rows with streaming state (problem 3).

Turn rows stream in, in any order and more than once. Their event time is the
turn's own. Streaming state keyed by the turn's place (chat, segment, session,
turn) and day buffers what arrives late and keeps the row that counts, one
struct a place, whatever the number of late or repeated rows. When the watermark,
``lateness`` behind the newest turn, has passed the day, the place leaves the
state; rows that come later still are dropped and counted.

A chat waits, as a table of the places that have left the state, until it is
closed: by timeout, when the days that have left the state are ``gap`` beyond its
last known activity, or by the closing mark that ends a stored history. Then it
is checked and, if sound, emitted.

Soundness is decided by sums per segment and chat, never by sorting a chat in one
task: places are 0, 1, 2 and so on in segment order exactly if each segment holds
a gapless run of distinct turn indexes that starts where the one before ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.runtime import cut, scratch

#: Event time of the closing mark.
END = "9000-01-01 00:00:00"
#: How far the newest turn may be ahead of a row that still counts.
LATENESS = "2 days"
#: Days without activity after which a chat is closed.
GAP_DAYS = 14
#: What a text must hold to count as a message.
VISIBLE = r"[\p{L}\p{N}]"
SPOT = ["tool", "native_id", "segment_index", "session_id", "turn_index"]


def chats_of(sessions: DataFrame) -> DataFrame:
    """One row per session id: its chat, segment, whether the chat's segments are 0, 1, 2 …, the chat's latest known activity, and when the session was ingested.

    Repeated rows of an id count once; rows without id, tool, native_id are left out.
    """
    seen = F.coalesce("last_turn_at", "last_ingested_at", "started_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    s = (sessions.where("id is not null and tool is not null and native_id is not null")
         .groupBy(F.col("id").alias("session_id")).agg(F.min(F.struct("tool", "native_id", "segment_index")).alias("k"), F.max(seen).alias("seen"), F.max(F.coalesce("last_ingested_at", seen)).alias("ingested"))
         .select("session_id", "k.*", "seen", "ingested"))
    per = s.groupBy("tool", "native_id").agg(
        F.max("seen").alias("chat_time"),
        ((F.min(F.coalesce("segment_index", F.lit(-1))) == 0) & (F.max("segment_index") + 1 == F.countDistinct("segment_index"))).alias("whole"))
    return s.drop("seen").join(per, ["tool", "native_id"])


def answered(turns: DataFrame) -> DataFrame:
    """``memory_id, ok``: whether a stored row has both a visible prompt and a visible reply."""
    ok = F.coalesce(F.col("user_prompt").rlike(VISIBLE) & F.col("assistant_response").rlike(VISIBLE), F.lit(False))
    return turns.where("memory_id is not null").groupBy("memory_id").agg(F.max(ok).alias("ok"))


def event_time(started: Column, ingested: Column) -> Column:
    """When a turn happened: when it started, but not after its session was ingested (a clock may be ahead); without it, when that was."""
    return F.least(F.coalesce(started, ingested), ingested).cast("timestamp")


def sound(closed: DataFrame) -> DataFrame:
    """Messages of the sound chats among closed places (``SPOT``, ``whole``, ``memory_id``, ``ok``)."""
    chat = ["tool", "native_id"]
    turns = closed.groupBy(*chat, "segment_index", "turn_index").agg(F.count("*").alias("n"), F.min(F.col("ok") & F.col("whole")).alias("ok"))
    segments = turns.groupBy(*chat, "segment_index").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.min("turn_index").alias("lo"), F.max("turn_index").alias("hi"),
        F.min(F.col("ok") & F.col("turn_index").isNotNull()).alias("ok"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*chat).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    good = F.coalesce(F.col("ok") & (F.col("most") == 1) & (F.col("lo") == before) & (F.col("hi") == before + F.col("n") - 1), F.lit(False))
    kept = segments.withColumn("good", good).groupBy(*chat).agg(F.min("good").alias("good")).where("good").drop("good")
    side = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("user").alias("speaker")), F.struct(F.lit(1).alias("at"), F.lit("assistant").alias("speaker"))))
    return (closed.join(kept, chat).withColumn("side", side)
            .select("tool", "native_id", (F.col("turn_index").cast("bigint") * 2 + F.col("side.at")).alias("msg_index"), F.col("side.speaker").alias("speaker"), "memory_id"))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


STATE = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("tool", T.StringType()), T.StructField("native_id", T.StringType()), T.StructField("segment_index", T.IntegerType()),
                      T.StructField("session_id", T.LongType()), T.StructField("turn_index", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("seen", T.TimestampType()),
                      T.StructField("reingested_at", T.TimestampNTZType()), T.StructField("memory_id", T.LongType())])
OPEN = "tool string, native_id string, segment_index int, session_id bigint, turn_index int, closes timestamp, at timestamp, seen timestamp, whole boolean, reingested_at timestamp_ntz, memory_id bigint"


MESSAGES = "tool string, native_id string, msg_index bigint, speaker string, memory_id bigint"


class Assembly:
    """Chats between leaving the state and being closed: tables in the shared folder, one for each epoch, so a repeated epoch replaces itself."""

    def __init__(self, base: str, texts: DataFrame, lateness: str, gap_days: int):
        self.base, self.texts, self.lateness, self.gap_days = base, texts, pd.Timedelta(lateness), gap_days
        self.waiting: dict[int, str] = {}
        self.passed: dict[int, float] = {}
        self.query: StreamingQuery | None = None
        #: rows that came too late and were dropped
        self.late = 0

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Add the places that leave the state, emit the chats that are closed, keep the others."""
        spark = batch.sparkSession
        before = max((e for e in self.waiting if e < epoch), default=None)
        came = f"{self.base}/came/epoch={epoch}"
        batch.select(*SPOT, F.col("closes.end").alias("closes"), "last.at", "last.seen", "last.whole", "last.reingested_at", "last.memory_id").write.mode("overwrite").parquet(came)
        rows = spark.read.schema(OPEN).parquet(came)
        # all days before the watermark, which is as far as the batches before have brought it, have left the state
        closed = rows.agg(F.max("closes").cast("double")).first()[0]
        newest = max((t for t in (closed, self._watermark(), self.passed.get(before)) if t is not None), default=None)
        if newest is None:
            return
        if closed is None and before is not None and newest == self.passed[before]:  # nothing has changed
            self.waiting[epoch], self.passed[epoch] = self.waiting[before], newest
            return
        if before is not None:
            rows = rows.unionByName(spark.read.schema(OPEN).parquet(self.waiting[before]))
        chat = ["tool", "native_id"]
        last = rows.groupBy(*chat).agg(F.greatest(F.max("at"), F.max("seen")).alias("last"))
        done = F.coalesce(F.col("last") + F.expr(f"interval {int(self.gap_days)} days") < F.timestamp_seconds(F.lit(newest)), F.lit(False))
        split = f"{self.base}/waiting/epoch={epoch}"
        rows.join(last.select(*chat, done.alias("done")), chat).write.mode("overwrite").partitionBy("done").parquet(split)
        rows.limit(0).write.mode("append").parquet(f"{split}/done=false")  # there even if nothing waits
        self.waiting[epoch], self.passed[epoch] = f"{split}/done=false", newest
        self._emit(spark.read.schema(f"{OPEN}, done boolean").parquet(split).where("done"), epoch)

    def _watermark(self) -> float | None:
        """Seconds of the watermark of this batch."""
        seen = self.query.lastProgress if self.query else None
        newest = seen.eventTime.get("max") if seen else None
        return (pd.Timestamp(newest) - self.lateness).timestamp() if newest and pd.Timestamp(newest) < pd.Timestamp(END, tz="UTC") else None

    def end(self, spark: SparkSession) -> None:
        """Close all chats that wait."""
        if self.waiting:
            last = max(self.waiting)
            self._emit(spark.read.schema(OPEN).parquet(self.waiting[last]), last + 1)
            self.waiting.clear()

    def _emit(self, ready: DataFrame, epoch: int) -> None:
        if ready.isEmpty():
            return
        # a place may have left the state on several days
        ready = ready.groupBy(*SPOT).agg(F.max(F.struct("reingested_at", "memory_id", "whole")).alias("last")).select(*SPOT, "last.memory_id", "last.whole")
        closed = cut(ready.join(self.texts, "memory_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "closed")
        sound(closed).write.mode("overwrite").parquet(f"{self.base}/sound/epoch={epoch}")


def rebuild(memories: DataFrame, sessions: DataFrame, turns: DataFrame, memories_path: str, lateness: str = LATENESS, gap_days: int = GAP_DAYS, files_per_trigger: int | None = None, ended: bool = True, counts: dict | None = None) -> DataFrame:
    """Stream ``memories_path`` (Parquet files of turn rows) through keyed state and give the messages of sound chats.

    Columns: ``tool, native_id, msg_index, speaker, memory_id``. ``memories``
    gives only the schema. Of several rows at one (session_id, turn_index) the
    one with the latest reingested_at (null is earliest), then the largest id,
    counts. Turns whose session is not stored belong to no chat. A chat is sound
    if its segments are 0, 1, 2 … without gap, its turns in segment and turn
    order are exactly 0, 1, 2 …, and each has a stored prompt and reply with a
    letter or digit; other chats are dropped whole. Null keys make a chat
    unsound (segment, turn) or a row stray (session). Empty tables give no rows,
    extra columns are ignored.

    ``lateness`` is how far the newest turn may be ahead of a row that still
    counts, ``gap_days`` how long a chat rests before it is closed; what comes to
    a closed chat later is a chat of its own, which does not begin at 0 and is
    not sound. ``files_per_trigger`` sets the size of the micro-batches: rows
    older than the watermark of earlier ones are dropped, and counted in
    ``counts["late"]``. By default a stored history is one micro-batch, because
    its files are in no order of time. ``ended`` closes all chats at the end.
    """
    spark = memories.sparkSession
    base = scratch(spark, "conversations")
    places = cut(chats_of(sessions), "chats")
    assembly = Assembly(base, cut(answered(turns), "answered"), lateness, gap_days)
    marks = f"{base}/marks"
    spark.createDataFrame([], STATE).write.parquet(marks)

    def run() -> None:
        reader = spark.readStream.schema(memories.schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        rows = (reader.parquet(memories_path).select(F.col("id").alias("memory_id"), "session_id", "turn_index", "reingested_at", "turn_started_at")
                .join(places, "session_id").withColumn("at", event_time(F.col("turn_started_at"), F.col("ingested"))).withColumn("seen", F.col("chat_time"))
                .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE]))
        every = rows.unionByName(spark.readStream.schema(STATE).parquet(marks))
        kept = (every.withWatermark("at", lateness)
                .groupBy(F.window("at", "1 day").alias("closes"), *SPOT)
                .agg(F.max(F.struct("reingested_at", "memory_id", "whole", "seen", "at")).alias("last")))
        query = kept.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(assembly.take).start()
        assembly.query = query
        query.awaitTermination()
        assembly.late += sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)

    with _conf(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        run()
        if ended:
            spark.createDataFrame([(END,)], "t string").select(*[(F.col("t").cast("timestamp") if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in STATE]).write.mode("append").parquet(marks)
            run()
            assembly.end(spark)
    if counts is not None:
        counts["late"] = assembly.late
    spark.createDataFrame([], MESSAGES).write.mode("overwrite").parquet(f"{base}/sound/epoch=-1")
    return spark.read.schema(MESSAGES).parquet(f"{base}/sound/epoch=*")

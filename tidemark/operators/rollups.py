"""Session rollups: merged notes, packed batches, budgets, attribution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E


def note_key(what: Column | str) -> Column:
    """What makes two notes one: the text without control characters and outer white space, lower case."""
    return F.lower(E.trimmed(E.without_control(what)))


def merged_decisions(memories: DataFrame) -> DataFrame:
    """Per session each distinct decision once: its first wording, reason and turn. Blank ones are dropped."""
    d = memories.select("session_id", "turn_index", "id", F.posexplode("decisions").alias("pos", "d")).where(~E.blank("d.what"))
    first = d.groupBy("session_id", note_key("d.what").alias("key")).agg(F.min(F.struct("turn_index", "id", "pos", "d")).alias("x"), F.count("*").alias("times"))
    return first.select("session_id", "key", F.col("x.d.what").alias("what"), F.when(~E.blank("x.d.why"), F.col("x.d.why")).alias("why"), F.col("x.turn_index").alias("turn_index"), "times")


def rollup(memories: DataFrame) -> DataFrame:
    """Per session: turns, distinct decisions, the last turn's open items (they replace earlier ones), distinct files, and the turn it goes up to."""
    notes = merged_decisions(memories).groupBy("session_id").agg(F.count("*").alias("decisions"))
    files = memories.select("session_id", F.explode("files_touched").alias("f")).groupBy("session_id").agg(F.countDistinct("f").alias("files"))
    base = memories.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("turn_index").alias("through"), F.max(F.struct("turn_index", "id", F.coalesce("pending_items", F.array().cast("array<string>")).alias("p"))).alias("x"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return base.join(notes, "session_id", "left").join(files, "session_id", "left").select("session_id", "turns", "through", n("decisions").alias("decisions"), n("files").alias("files"), F.size("x.p").cast("bigint").alias("pending"))


def advance(rollups: DataFrame, batch: DataFrame) -> DataFrame:
    """Rollups with the rows of a batch that continue them: only rows whose ``expected`` is the turn the rollup goes up to."""
    ok = batch.join(rollups.select("session_id", F.col("through").alias("_t")), "session_id", "left").where(F.col("expected").eqNullSafe(F.col("_t"))).drop("_t", "expected")
    return rollups.join(ok.select("session_id"), "session_id", "left_anti").unionByName(ok)


def pack(rows: DataFrame, key: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Batch numbers: rows in order, a new batch where the next one would pass ``limit``; a row beyond it stands alone.

    The sum starts anew at each batch, so it is no prefix sum: the rows of a key
    come in order and are walked once, however many there are; only sizes are
    walked, texts stay outside.
    """
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, batch_no, total = object(), 0, 0
        for part in batches:
            out = []
            for k, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if k != current:
                    current, batch_no, total = k, 0, 0
                if total > 0 and total + s > limit:
                    batch_no, total = batch_no + 1, 0
                total += s
                out.append(batch_no)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int32())], names=[key, "_n", "batch"])

    sizes = n.select(key, "_n", F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_s")).repartition(key).sortWithinPartitions(key, "_n")
    numbers = sizes.mapInArrow(walk, f"`{key}` {kind}, _n int, batch int").withColumnRenamed(key, "_k")
    return n.join(numbers, F.col(key).eqNullSafe(F.col("_k")) & (n["_n"] == numbers["_n"])).drop("_n", "_k")


def newest_within(rows: DataFrame, key: str, order: list[Column], size: Column, budget: int, separator: int = 1) -> DataFrame:
    """The newest rows of each key whose sizes, with separators, stay within a budget: up to the first that does not fit."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size + separator).over(w) - separator).where(F.col("_sum") <= budget).drop("_sum")


#: Words that tell nothing of where a decision came from.
STOP_WORDS = ("the", "a", "an", "to", "for", "and", "or", "with", "by", "as", "at", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "from", "into", "use", "used", "using", "in", "on", "of")


def telling_words(x: Column | str) -> Column:
    """Distinct words of a text that tell it from others: ASCII words and paths of three characters or more that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(E._c(x), F.lit(""))), r"[^a-z0-9_./-]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def attribute(decisions: DataFrame, turns: DataFrame, least: float = 0.5) -> DataFrame:
    """``session_id, key, turn_index, how``: the turn each decision came from.

    ``decisions`` has ``session_id, key, what, claimed``, ``turns`` ``session_id,
    turn_index, decisions`` (a batch's turns with their own decision texts). A
    claimed turn counts if it is one of the batch (``claimed``); else the turn
    whose decisions share most words, at least half of the smaller set, the
    earliest of equals (``matched``); else the last turn (``last``). Decisions
    meet turns by the words they share, not each with each.
    """
    t = turns.select("session_id", F.col("turn_index").alias("t"), telling_words(F.array_join("decisions", " ")).alias("words")).withColumn("theirs", F.size("words"))
    d = decisions.select("session_id", "key", "claimed", telling_words("what").alias("words")).withColumn("own", F.size("words"))
    shared = (d.select("session_id", "key", "own", F.explode("words").alias("w")).join(t.select("session_id", "t", "theirs", F.explode("words").alias("w")), ["session_id", "w"])
              .groupBy("session_id", "key", "own", "t", "theirs").agg(F.count("*").alias("n")))
    score = F.col("n") / F.least("own", "theirs")
    best = shared.where(score >= least).groupBy("session_id", "key").agg(F.min(F.struct((-score).alias("neg"), "t")).alias("best"))
    is_turn = t.select("session_id", F.col("t").alias("claimed"), F.lit(True).alias("is_turn")).distinct()
    last = t.groupBy("session_id").agg(F.max("t").alias("last"))
    g = d.drop("words", "own").join(is_turn, ["session_id", "claimed"], "left").join(best, ["session_id", "key"], "left").join(last, "session_id")
    how = F.when(F.col("is_turn"), "claimed").when(F.col("best").isNotNull(), "matched").otherwise("last")
    return g.select("session_id", "key", F.when(F.col("is_turn"), F.col("claimed")).otherwise(F.coalesce("best.t", "last")).alias("turn_index"), how.alias("how"))


def failure_windows(events: DataFrame, key: str, order: list[str], failed: Column, size: int = 20, least: int = 5, share: float = 0.3) -> DataFrame:
    """Where the failure share of the last ``size`` events of a key begins to reach ``share`` (of at least ``least`` events)."""
    w = Window.partitionBy(key).orderBy(*order)
    f = w.rowsBetween(-(size - 1), 0)
    high = (F.count("*").over(f) >= least) & (F.avg(failed.cast("double")).over(f) >= share)
    e = events.withColumn("high", high).withColumn("ratio", F.round(F.avg(failed.cast("double")).over(f), 6))
    return e.withColumn("was", F.coalesce(F.lag("high").over(w), F.lit(False))).where("high and not was").drop("high", "was")

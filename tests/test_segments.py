import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments
from tidemark.streaming.sessions import latest_version, segment_stream, upsert_parquet

T0 = datetime(2025, 1, 1)


def loop(rows):
    """An independent version: one turn after the other."""
    out, seg, branch, files, last = [], 0, None, [], None
    for n, (at, b, f) in enumerate(rows):
        gap = 0.0 if last is None or at is None else max(0.0, (at - last).total_seconds() / 3600)
        if n:
            both = files and f
            o = len(set(files) & set(f)) / len(set(files) | set(f)) if both else None
            cut = gap >= 168
            if not cut and gap >= 4 and not (o is not None and o >= 0.5):
                cut = bool(branch and b and branch != b) or (o is not None and o < 0.2 and not (branch and b and branch == b))
            if cut:
                seg, branch, files = seg + 1, None, []
        branch = b or branch
        files = list(dict.fromkeys(f + files))[:50]
        last = at
        out.append(seg)
    return out


def generated(seed, keys=12, n=40):
    rnd, rows = random.Random(seed), []
    for k in range(keys):
        at = T0
        for i in range(n):
            at += timedelta(hours=rnd.choice([0.1, 1, 3.9, 4, 5, 30, 167, 168, 200]))
            rows.append((f"k{k}", i, at if rnd.random() > 0.05 else None, rnd.choice(["a", "b", None]), rnd.sample("pqrstuvwxyz", rnd.randint(0, 4))))
    return rows


SCHEMA = "key string, turn int, at timestamp_ntz, branch string, files array<string>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_loop(spark, seed):
    rows = generated(seed)
    got = {(r.key, r.turn): r.segment for r in segments.with_state(spark.createDataFrame(rows, SCHEMA), "key", "at", ["turn"], "branch", "files").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert [got[k, r[1]] for r in own] == loop([r[2:] for r in own])


@pytest.mark.parametrize("gap,was,now,a,b,marker,cut", [
    (168, "x", "x", ["f"], ["f"], False, True), (3.9, "x", "y", ["f"], ["g"], True, False), (4, "x", "y", [], [], False, True), (10, "x", "x", ["f"], ["g"], False, False), (10, None, "x", ["f"], ["g"], False, True),
    (10, "x", "y", ["f", "g"], ["f"], True, False), (10, "x", "x", [], ["g"], True, True), (10, None, None, [], [], False, False), (10, "x", None, ["a", "b", "c", "d"], ["a", "e"], False, False)])
def test_thresholds(spark, gap, was, now, a, b, marker, cut):
    arr = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    row = spark.range(1).select(segments.assess(F.lit(float(gap)), F.lit(was).cast("string"), F.lit(now).cast("string"), arr(a), arr(b), F.lit(marker)).alias("c")).first()
    assert row.c is cut


def test_stream_equals_loop(spark, tmp_path):
    rows = [r for r in generated(5, keys=5, n=20) if r[2] is not None]
    times = sorted({r[2] for r in rows})
    third = times[len(times) // 3]
    for part, own in (("a", [r for r in rows if r[2] <= third]), ("b", [r for r in rows if r[2] > third])):
        spark.createDataFrame(own, SCHEMA).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / part))
    src = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    q = segment_stream(src, "4000 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, i: seen.extend(df.collect())).start()
    q.awaitTermination()
    got = {}
    for r in seen:
        got[r.key, r.segment] = max(got.get((r.key, r.segment), 0), r.turns)
    want = {}
    for k in {r[0] for r in rows}:
        for s in loop([r[2:] for r in rows if r[0] == k]):
            want[k, s] = want.get((k, s), 0) + 1
    assert got == want


def test_upsert_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = upsert_parquet(path, ["k"], "n")
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, v string")
    two = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (1, 0, "old")], "k int, n int, v string")
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    rows = lambda epoch: {tuple(r) for r in latest_version(spark, path, epoch, one.schema).collect()}
    assert rows(1) == {(1, 1, "a"), (2, 2, "c"), (3, 1, "d")} and rows(0) == {(1, 1, "a"), (2, 1, "b")}
    sink(one.limit(0), 2)
    assert rows(2) == rows(1)
    sink(spark.createDataFrame([(2, 9, "e")], one.schema), 3)
    assert rows(3) == {(1, 1, "a"), (2, 9, "e"), (3, 1, "d")}
    # only the part that holds the key is written again
    assert len(list((tmp_path / "t" / "data" / "version=3").glob("_part=*"))) == 1


def test_empty(spark):
    assert segments.with_state(spark.createDataFrame([], SCHEMA), "key", "at", ["turn"], "branch", "files").count() == 0


def test_markers_cut_within_a_week_unless_the_files_speak_against_it(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("k", 0, at(0), "b", ["f"], True), ("k", 1, at(1), "b", ["f"], True), ("k", 2, at(9), "b", ["x"], True), ("k", 3, at(20), "b", ["x"], True), ("k", 4, at(30), "b", None, False)]
    df = spark.createDataFrame(rows, "key string, turn int, at timestamp, branch string, files array<string>, marker boolean")
    got = segments.with_state(df, "key", "at", ["turn"], "branch", "files", "marker").orderBy("turn").collect()
    assert [r.segment for r in got] == [0, 0, 1, 1, 1]

from datetime import datetime

import numpy as np
import pytest

from tidemark.llm import neighbours

SCHEMA = "session_id bigint, computed_at timestamp_ntz, model string, model_revision string, dimensions int, vector array<float>, a string, sim string, p string"
T0 = datetime(2025, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "s", "p") for r in rows], SCHEMA)


def clusters(seed, groups, each, dims=48, model="m"):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.repeat(centre, each, axis=0) + rng.normal(size=(groups * each, dims)) * 0.35 / np.sqrt(dims)
    return x * rng.uniform(0.1, 9, size=(len(x), 1))


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:k]}


@pytest.mark.parametrize("size", [2048, 150])
def test_recall(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "LIST", size)
    x = clusters(5, 90, 14)
    rows = [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]
    got = {(r.a, r.b) for r in neighbours.nearest(table(spark, rows), 10).collect()}
    want = exact(x, 10)
    assert len(got) == len(want) and len(got & want) / len(want) > (0.99 if size == 2048 else 0.9)


def test_small_groups_ties_and_unusable(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, T0, "m", None, 3, one), (2, T0, "m", None, 3, one), (3, T0, "m", None, 3, [2.0, 0.0, 0.0]), (4, T0, "m", "r", 3, one), (5, T0, None, "r", 3, one), (6, T0, None, "r", 3, [0.0, 1.0, 0.0]),
            (7, T0, "m", None, 3, None), (8, T0, "m", None, 3, [0.0, 0.0, 0.0]), (9, T0, "m", None, 3, [float("nan"), 1.0, 0.0]), (10, T0, "m", None, 4, one), (11, T0, "m", None, 3, [1.0, None, 0.0]), (None, T0, "m", None, 3, one), (12, T0, "m", None, None, one), (13, T0, "m", None, 3, []),
            (14, T0, "m", None, 3, one), (14, datetime(2025, 2, 1), "m", None, 3, [0.0, 0.0, 0.0]), (15, None, "m", None, 3, None), (15, T0, "m", None, 3, [1e30, 1e30, 0.0])]
    got = {(r.session_id_a, r.session_id_b) for r in neighbours.neighbour_pairs(table(spark, rows + rows[:3])).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 15), (2, 15), (3, 15), (5, 6)}


def test_many_copies_and_empty(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 64)
    rows = [(i, T0, "m", "r", 4, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    got = neighbours.nearest(table(spark, rows), 10).groupBy("a").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {10}
    assert neighbours.neighbour_pairs(table(spark, [])).count() == 0


def test_recall_in_a_dense_cluster_far_above_a_list(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 64)
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", 4)
    x = clusters(7, 1, 1500)
    rows = [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]
    got = {(r.a, r.b) for r in neighbours.nearest(table(spark, rows), 10).collect()}
    want = exact(x, 10)
    assert len(got) == len(want) and len(got & want) / len(want) > 0.98


def test_cutting_lists_loses_nothing(spark, monkeypatch):
    x = clusters(9, 40, 30, dims=64)
    rows = [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "CANDIDATES", 24)
    sims = []
    for size in (16384, 64):
        monkeypatch.setattr(neighbours, "LIST", size)
        sims.append({(r.a, r.rank): r.sim for r in neighbours.nearest(table(spark, rows), 10).collect()})
    assert sims[0].keys() <= sims[1].keys() and all(sims[1][k] >= s - 1e-6 for k, s in sims[0].items())


def test_recall_in_lists_much_longer_than_the_candidates(spark, monkeypatch):
    # as in groups of millions, where a list holds some 70 times the candidates
    monkeypatch.setattr(neighbours, "CANDIDATES", 14)
    x = clusters(11, 200, 15, dims=96)
    rows = [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]
    got = {(r.a, r.b) for r in neighbours.nearest(table(spark, rows), 10).collect()}
    want = exact(x, 10)
    print("recall", len(got & want) / len(want))
    assert len(got) == len(want) and len(got & want) / len(want) > 0.95


def test_blocks_bring_every_query_to_every_member_once(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40).select("id", F.inline(neighbours._blocks(F.lit(3), F.lit(3), "both")))
    asked, answers = ids.where("q").select("qb", "mb", F.col("id").alias("a")), ids.where("m").select("qb", "mb", F.col("id").alias("b"))
    assert sorted(tuple(r) for r in asked.join(answers, ["qb", "mb"]).select("a", "b").collect()) == [(a, b) for a in range(40) for b in range(40)]
    asked = spark.range(10).select("id", F.inline(neighbours._blocks(F.lit(2), F.lit(3), "q"))).select("qb", "mb", F.col("id").alias("a"))
    answers = spark.range(20).select("id", F.inline(neighbours._blocks(F.lit(2), F.lit(3), "m"))).select("qb", "mb", F.col("id").alias("b"))
    assert sorted(tuple(r) for r in asked.join(answers, ["qb", "mb"]).select("a", "b").collect()) == [(a, b) for a in range(10) for b in range(20)]


def test_only_footrule_candidates_are_multiplied():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, d, width = 400, 16, 4
    v = rng.normal(size=(n, d)).astype(np.float32)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16)
    p = np.argsort(-(v.astype(np.float32) @ v[:20].T.astype(np.float32)), axis=1)[:, :width].astype(np.int32)
    t = pa.table({"id": np.arange(n), "dims": np.full(n, d, np.int32), "q": np.ones(n, bool), "m": np.ones(n, bool), "v": pa.array([x.tobytes() for x in v]), "p": pa.array(p.tolist(), pa.list_(pa.int32()))})
    out = neighbours._ranked(5)(t).to_pydict()

    def footrule(a, b):
        place = {x: i for i, x in enumerate(b)}
        other = {x: i for i, x in enumerate(a)}
        return sum(abs(i - place.get(x, width)) for i, x in enumerate(a)) + sum(width - i for i, x in enumerate(b) if x not in other)

    for a in range(0, n, 37):
        dist = sorted((footrule(p[a], p[b]), b) for b in range(n) if b != a)
        edge = dist[neighbours.CANDIDATES][0]
        got = [b for x, b in zip(out["a"], out["b"]) if x == a]
        assert len(got) == 6 and all(footrule(p[a], p[b]) <= edge for b in got)


def test_copies_share_their_neighbours(spark):
    x = clusters(3, 4, 6)
    rows = [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]
    rows += [(100 + i, T0, "m", "r", x.shape[1], x[0].tolist()) for i in range(40)] + [(200 + i, T0, "m", "r", x.shape[1], x[1].tolist()) for i in range(2)]
    got = {}
    for r in neighbours.nearest(table(spark, rows), 10).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert len(got) == len(rows) and all(len(v) == 10 for v in got.values())
    assert all(got[100 + i] <= {0, *range(100, 140)} for i in range(40)) and got[0] <= set(range(100, 140))
    assert {1, 200, 201} - {1} <= got[1] and {1, 201} <= got[200]


def files_at_most(spark, work):
    """Bytes at most, while ``work`` runs, of the shuffle files and cut tables that come to be."""
    import threading
    from pathlib import Path

    from tidemark import runtime

    places = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), runtime.local_path(runtime.shared_dir(spark))]

    def sizes():
        out = {}
        for p in (p for at in places for kind in ("shuffle_*", "*.parquet") for p in Path(at).rglob(kind)):
            try:
                out[p] = p.stat().st_size
            except OSError:
                pass
        return out

    old, most, over = sizes(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], sum(n for p, n in sizes().items() if p not in old))

    t = threading.Thread(target=watch)
    t.start()
    try:
        work()
    finally:
        over.set()
        t.join()
    return most[0]


def test_disk_is_a_few_copies_of_the_vectors(spark, monkeypatch):
    # with lists of 200 many rows are posted three times and more in each of their seven
    monkeypatch.setattr(neighbours, "LIST", 200)
    monkeypatch.setattr(neighbours, "PASS_BYTES", 0, raising=False)
    x = np.random.default_rng(13).normal(size=(1500, 384)).astype(np.float32)
    df = table(spark, [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]).repartition(4).localCheckpoint()
    most = files_at_most(spark, lambda: neighbours.nearest(df, 10).count())
    print("copies of the input", most / x.nbytes)
    assert most < 2.5 * x.nbytes


def test_passes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 100)
    x = clusters(15, 25, 16)
    df = table(spark, [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)])
    got = []
    for size in (1 << 30, 1 << 18):
        monkeypatch.setattr(neighbours, "PASS_BYTES", size)
        got.append({(r.a, r.rank): r.sim for r in neighbours.nearest(df, 10).collect()})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - s) < 1e-6 for k, s in got[1].items())


def test_whole_groups_in_passes(spark, monkeypatch):
    from tidemark import runtime

    monkeypatch.setattr(neighbours, "LIST", 32)
    monkeypatch.setattr(neighbours, "PASS_BYTES", 0)
    x = clusters(17, 30, 4)
    rows = neighbours.latest_usable(table(spark, [(i, T0, "m", "r", x.shape[1], v.tolist()) for i, v in enumerate(x)]))
    none = runtime.cut(runtime.empty(spark, neighbours.FOUND), "none")
    got = neighbours._whole(none, rows, rows.where("id < 40"), 120 * (2 * x.shape[1] + 64), 10).collect()
    want = {(a, b) for a, b in exact(x, 10) if a < 40}
    assert len(got) == len(want) and len({(r.a, r.b) for r in got} & want) / len(want) > 0.99

from collections import Counter

import pytest

from tidemark.llm.mixture import draw, shares


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, "hot", 50 + i % 90) for i in range(4000)] + [(10_000 + i, "small", 100) for i in range(40)] + [(20_000 + i, "mid", 30 + i % 7) for i in range(900)]
    rows += [(30_000, None, 10), (30_001, "hot", 0), (30_002, "none", 10)]
    return frame(spark, rows).cache()


def test_shares_and_caps(spark, counted):
    t = targets(spark, [("hot", 0.2, 3), ("small", 0.3, 4), ("mid", 0.1, 5), ("missing", 0.4, 2)])
    total = counted.groupBy().sum("n_tokens").first()[0]
    rows = draw(counted, t).collect()
    used = Counter(r.doc_id for r in rows)
    by = Counter()
    for r in rows:
        by[r.source] += r.n_tokens
    assert by["hot"] == pytest.approx(0.2 * total, rel=0.01)
    assert by["mid"] == pytest.approx(0.1 * total, rel=0.02)
    assert by["small"] == 40 * 100 * 4  # the cap binds
    assert max(n for i, n in used.items() if 10_000 <= i < 20_000) == 4 and max(used.values()) <= 5
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((i, k) for i, n in used.items() for k in range(1, n + 1))
    s = {r.source: r for r in shares(draw(counted, t), counted, t).collect()}
    assert set(s) == {"hot", "small", "mid", "missing"} and s["missing"].drawn_tokens == 0
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1)


def test_copies_differ_by_one_at_most(spark):
    rows = frame(spark, [(i, "a", 10) for i in range(1000)])
    used = Counter(r.doc_id for r in draw(rows, targets(spark, [("a", 1.0, 9)]), total=25_000).collect())
    assert sum(used.values()) in (2499, 2500, 2501) and set(used.values()) == {2, 3}


def test_empty_null_and_repeated(spark):
    t = targets(spark, [("a", 0.5, 2), ("a", 0.5, 3), (None, 1.0, 1), ("b", None, 2), ("c", 1.0, None)])
    none = frame(spark, [])
    assert draw(none, t).count() == 0 and shares(draw(none, t), none, t).count() == 3
    rows = frame(spark, [(1, "a", 5), (1, "a", 5), (2, "b", 5), (3, "c", 5), (None, "a", 5)])
    got = Counter((r.doc_id, r.source) for r in draw(rows.withColumn("rate", rows.n_tokens).withColumn("cls", rows.source), t, total=100).collect())
    assert {s for _, s in got} == {"a"} and sum(got.values()) == 6  # cap 2 for each of three records

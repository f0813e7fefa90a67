import random
import string

import numpy as np
import pytest

from tidemark.llm import spans

SCHEMA = "memory_id bigint, user_prompt string, assistant_response string, fp string, n string"


def brute(rows):
    owner = {}
    for i, u, a in rows:
        for t in (u, a):
            for k in range(len(t or "") - spans.SPAN + 1):
                w = t[k:k + spans.SPAN]
                owner[w] = i if owner.get(w, i) == i else -1
    out = {}
    for i, u, a in rows:
        for f, t in zip(spans.FIELDS, (u, a)):
            cover = set()
            for k in range(len(t or "") - spans.SPAN + 1):
                if owner[t[k:k + spans.SPAN]] == -1:
                    cover |= set(range(k, k + spans.SPAN))
            if cover:
                out[i, f] = max(len(cover), out.get((i, f), 0))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase + "éß日😀") for _ in range(rnd.randint(2, 9)))
    text = lambda m: " ".join(word() for _ in range(m))
    shared = [text(60)[:k] for k in (199, 200, 201, 230, 330)]
    rows = []
    for i in range(n):
        u, a = text(rnd.randint(1, 40)), text(rnd.randint(1, 90))
        if rnd.random() < 0.5:
            u = u + rnd.choice(shared) + text(5)
        if rnd.random() < 0.4:
            a = text(3) + rnd.choice(shared) + a
        if rnd.random() < 0.1 and rows:
            a = rows[-1][2]
        rows.append((i, u, a))
    return rows


def tables(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,hot,broadcast", [(1, 4096, 1 << 20), (2, 2, 1 << 20), (3, 4096, 0), (4, 5, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, broadcast):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "BROADCAST_PRINTS", broadcast)
    monkeypatch.setattr(spans, "BROADCAST_TEXTS", broadcast)
    rows = corpus(seed)
    want = brute(rows)
    df = tables(spark, rows)
    assert want and {tuple(r) for r in spans.texts_with_shared_spans(df).collect()} == set(want)
    got = {(r.memory_id, r.field): r.shared_chars for r in spans.shared_shares(df).collect() if r.shared_chars}
    assert got == want


def test_repeats_own_fields_nulls_and_empty(spark):
    long = "".join(random.Random(9).choice(string.printable) for _ in range(400))
    rows = [(1, long, long), (1, long, long), (2, None, ""), (3, long[:199], "x"), (None, long, long)]
    assert spans.texts_with_shared_spans(tables(spark, rows)).count() == 0
    rows.append((4, "head " + long[100:300] + " tail", None))
    got = {tuple(r) for r in spans.texts_with_shared_spans(tables(spark, rows)).collect()}
    assert got == {(1, "user_prompt"), (1, "assistant_response"), (4, "user_prompt")}
    assert spans.texts_with_shared_spans(tables(spark, [])).count() == 0
    assert {r.share for r in spans.shared_shares(tables(spark, [(7, "", None)])).collect()} == {0.0}


def test_very_long_and_uniform_texts(spark):
    same = "ab" * 40_000
    rows = [(1, same, None), (2, same[:500], None), (3, "b" * 300, None)]
    assert {tuple(r) for r in spans.texts_with_shared_spans(tables(spark, rows)).collect()} == {(1, "user_prompt"), (2, "user_prompt")}


def test_a_long_run_of_one_character_in_many_texts(spark):
    long = "x" * 1_000_000
    rows = [(i, "y" * (i % 7) + "=" * (3_000 + i), None) for i in range(300)] + [(1000, long, None), (1001, "-" * 150 + long, "ab" * 400), (1002, "ab" * 300, None), (1003, "q" * 5_000, None)]
    got = {(r.memory_id, r.field): r.shared_chars for r in spans.shared_shares(tables(spark, rows)).collect()}
    # the least window of a text may hold what stands before the run
    assert all(got[i, "user_prompt"] >= 3_000 + i for i in range(299))
    assert got[1000, "user_prompt"] == len(long) and got[1001, "user_prompt"] == len(long) and got[1001, "assistant_response"] == 800 and got[1002, "user_prompt"] == 600 and got[1003, "user_prompt"] == 0


def test_windows_with_one_hash_are_told_apart_by_text(monkeypatch):
    monkeypatch.setattr(spans, "gram_hashes", lambda c, size: np.zeros(max(len(c) - size + 1, 0), np.uint64))
    a, b = "a" * 150 + "b" * 60, "a" * 140 + "b" * 60 + "c" * 20
    got = sorted(spans._shared_windows([1, 2, 3], [0, 0, 0], [5, 7, 9], [a, b, "z" * 200]))
    same = {(k, j) for k in range(11) for j in range(21) if a[k:k + 200] == b[j:j + 200]}
    assert {(1, 0, 5 + k, 205 + k, 1) for k, _ in same} == {x for x in got if x[0] == 1} and {(2, 0, 7 + j, 207 + j, 1) for _, j in same} == {x for x in got if x[0] == 2} and not [x for x in got if x[0] == 3]


def test_clusters(spark):
    rnd = random.Random(9)
    text = lambda: "".join(rnd.choice(string.ascii_lowercase + " ") for _ in range(260))
    a, b, c = text(), text(), text()
    rows = [(5, a, None), (7, text(), a + b), (9, b, c), (4, text(), text()), (20, c, None), (30, x := text(), None), (31, "1" + x, None), (None, a, a)]
    for hot in (1 << 17, 3):
        spans.HOT, old = hot, spans.HOT
        try:
            assert sorted(map(tuple, spans.clusters(tables(spark, rows)).collect())) == [(5, 5, 1), (7, 5, 1), (9, 5, 2), (20, 5, 1), (30, 30, 1), (31, 30, 1)]
        finally:
            spans.HOT = old
    assert spans.clusters(tables(spark, [])).count() == 0

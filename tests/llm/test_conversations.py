import os
import random
from datetime import datetime, timedelta

import pytest

from tidemark.llm.conversations import rebuild

MEM = "id bigint, session_id bigint, turn_index int, reingested_at timestamp_ntz, tool string, whole string, turn_started_at timestamp_ntz"
SES = "id bigint, tool string, native_id string, segment_index int, started_at timestamp_ntz, last_ingested_at timestamp_ntz, last_turn_at timestamp_ntz, seen string"
TUR = "memory_id bigint, user_prompt string, assistant_response string, ok string"


def run(spark, tmp_path, mem, ses, tur, parts=1, **kw):
    m = spark.createDataFrame([(*r, None)[:7] for r in mem], MEM)
    path = str(tmp_path / "memories.parquet")
    m.repartition(parts).write.parquet(path)
    got = rebuild(m, spark.createDataFrame(ses, SES), spark.createDataFrame(tur, TUR), path + "*", **kw)
    return sorted(tuple(r) for r in got.collect())


def expected(mem, ses, tur):
    ok = {}
    for i, u, a, *_ in tur:
        vis = lambda t: t is not None and any(ch.isalnum() for ch in t)
        ok[i] = ok.get(i, False) or vis(u) and vis(a)
    chat = {s[0]: s[1:4] for s in ses if s[0] is not None and s[1] and s[2]}
    segs = {}
    for t, n, g in chat.values():
        segs.setdefault((t, n), []).append(g)
    best = {}
    for i, s, t, r, *_ in mem:
        k = (s, t)
        if k not in best or ((r or datetime.min), i) > best[k]:
            best[k] = ((r or datetime.min), i)
    turns = {}
    for (s, t), (_, i) in best.items():
        if s in chat:
            turns.setdefault(chat[s][:2], []).append((chat[s][2], t, i))
    out = []
    for c, rows in turns.items():
        g = set(segs[c])
        if None in g or g != set(range(len(g))) or any(t is None for _, t, _ in rows):
            continue
        rows.sort()
        if [t for _, t, _ in rows] == list(range(len(rows))) and all(ok.get(i) for _, _, i in rows):
            out += [(*c, 2 * k + e, who, i) for k, (_, _, i) in enumerate(rows) for e, who in ((0, "user"), (1, "assistant"))]
    return sorted(out)


def generated(seed, chats=40):
    rnd, mem, ses, tur = random.Random(seed), [], [], []
    now = datetime(2025, 1, 1)
    sid = mid = 0
    for c in range(chats):
        turn, tool = 0, rnd.choice(["codex", "opencode"])
        for g in range(rnd.randint(1, 3)):
            sid += 1
            if rnd.random() < 0.05:
                continue
            day = now + timedelta(days=rnd.randint(0, 300))
            row = (sid, tool, f"n{c}", g, day, day, None if rnd.random() < 0.3 else day, None)
            ses += [row] * rnd.choice([1, 1, 2])
            for _ in range(rnd.randint(1, 4)):
                mid += 1
                if rnd.random() < 0.04:
                    turn += 1
                    continue
                mem += [(mid, sid, turn, None, "t", None)] * rnd.choice([1, 1, 2])
                tur += [(mid, rnd.choice(["hi", "hi", "hi", "hi", "hi", "hi", "?"]), "yes", None)]
                if rnd.random() < 0.1:
                    mid += 1
                    mem.append((mid, sid, turn, day, "t", None))
                    tur.append((mid, "again", rnd.choice(["ok", None, " "]), None))
                turn += 1
    return mem, ses, tur


@pytest.mark.parametrize("seed,parts,per", [(1, 1, None), (2, 5, 1)])
def test_equals_brute_force(spark, tmp_path, seed, parts, per):
    mem, ses, tur = generated(seed)
    want = expected(mem, ses, tur)
    assert want and run(spark, tmp_path, mem, ses, tur, parts, files_per_trigger=per, lateness="3650 days") == want


def test_nulls_and_strays(spark, tmp_path):
    d = datetime(2025, 5, 1)
    ses = [(1, "a", "x", 0, None, None, None, None), (2, None, "y", 0, d, d, d, None), (None, "a", "z", 0, d, d, d, None), (3, "a", "w", None, d, d, d, None), (4, "a", "v", 1, d, d, d, None), (5, "a", "e", 0, d, d, d, None)]
    mem = [(1, 1, 0, None, None, None), (2, 1, 1, None, None, None), (3, 2, 0, None, None, None), (4, None, 0, None, None, None), (5, 3, 0, None, None, None), (6, 4, 0, None, None, None), (7, 99, 0, None, None, None), (8, 5, None, None, None, None)]
    tur = [(i, "q", "r", None) for i in range(1, 9)] + [(None, "q", "r", None)]
    assert [x[1:] for x in run(spark, tmp_path, mem, ses, tur)] == [("x", 0, "user", 1), ("x", 1, "assistant", 1), ("x", 2, "user", 2), ("x", 3, "assistant", 2)]


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], [], []) == []


def feed(spark, tmp_path, batches, ses, tur, **kw):
    """Each batch of memories is a file of its own, in order."""
    path = tmp_path / "feed"
    path.mkdir()
    for n, rows in enumerate(batches):
        part = tmp_path / f"part{n}"
        spark.createDataFrame(rows, MEM).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        to = path / f"{n}.parquet"
        to.write_bytes(file.read_bytes())
        os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))
    counts = {}
    got = rebuild(spark.createDataFrame([], MEM), spark.createDataFrame(ses, SES), spark.createDataFrame(tur, TUR), str(path), files_per_trigger=1, counts=counts, **kw)
    return sorted((r.native_id, r.msg_index, r.memory_id) for r in got.collect()), counts


def turn(i, session, index, day, again=None):
    return (i, session, index, again, "t", None, datetime(2025, 1, 1) + timedelta(days=day))


def chat(i, name, day, segment=0):
    d = datetime(2025, 1, 1) + timedelta(days=day)
    return (i, "a", name, segment, d, datetime(2026, 1, 1), d, None)


TEXTS = [(i, "q", "r", None) for i in range(1, 40)]


def test_chats_are_closed_by_timeout(spark, tmp_path):
    ses = [chat(1, "x", 0), chat(2, "y", 40), chat(3, "z", 80)]
    batches = [[turn(1, 1, 0, 0), turn(2, 1, 1, 1)], [turn(3, 2, 0, 40)], [turn(4, 3, 0, 80)]]
    got, counts = feed(spark, tmp_path, batches, ses, TEXTS, ended=False)
    # the last chat and those within the gap still wait
    assert got == [("x", 0, 1), ("x", 1, 1), ("x", 2, 2), ("x", 3, 2), ("y", 0, 3), ("y", 1, 3)] and counts == {"late": 0}


def test_late_rows_are_buffered_within_the_lateness_and_dropped_beyond(spark, tmp_path):
    ses = [chat(1, "x", 0), chat(2, "y", 3), chat(3, "z", 60)]
    batches = [[turn(2, 1, 1, 1.5), turn(3, 2, 0, 3)], [turn(1, 1, 0, 1.4), turn(9, 1, 1, 1.5, datetime(2025, 1, 9))], [turn(4, 3, 0, 60)], [turn(5, 2, 1, 3.5), turn(6, 3, 1, 59)], [turn(7, 2, 2, 3.6), turn(8, 3, 2, 60)]]
    got, counts = feed(spark, tmp_path, batches, ses, TEXTS)
    assert got == [("x", 0, 1), ("x", 1, 1), ("x", 2, 9), ("x", 3, 9), ("y", 0, 3), ("y", 1, 3), ("y", 2, 5), ("y", 3, 5)] + [("z", 2 * k + e, i) for k, i in enumerate((4, 6, 8)) for e in (0, 1)]
    # the engine drops by the watermark that the batch before had: the row of day 3 that comes first is still in time, the next is not
    assert counts == {"late": 1}


def test_a_chat_that_rests_within_the_gap_is_one(spark, tmp_path):
    ses = [chat(1, "x", 0), chat(2, "x", 9, 1), chat(3, "z", 60)]
    batches = [[turn(1, 1, 0, 0)], [turn(2, 2, 1, 9)], [turn(3, 3, 0, 60)]]
    got, _ = feed(spark, tmp_path, batches, ses, TEXTS, ended=False)
    assert got == [("x", 0, 1), ("x", 1, 1), ("x", 2, 2), ("x", 3, 2)]


def test_clocks_ahead_do_not_move_the_watermark(spark, tmp_path):
    d = datetime(2025, 1, 2)
    ses = [(1, "a", "x", 0, d, d, d, None), (2, "a", "y", 0, d, d, d, None)]
    got, counts = feed(spark, tmp_path, [[turn(1, 1, 0, 9_000)], [turn(2, 2, 0, 0.5), turn(3, 1, 1, 1)]], ses, TEXTS)
    assert len(got) == 6 and counts == {"late": 0}

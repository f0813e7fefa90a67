"""Serving and upkeep on small tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators import serving, transcripts, upkeep

T0 = datetime(2025, 6, 1)


def test_newest_activity_of_another_chat(spark):
    cols = "id bigint, native_id string, project_id bigint, kind string, last_turn_at timestamp, last_ingested_at timestamp, started_at timestamp"
    s = spark.createDataFrame([(1, "a", 1, "main", T0, T0, T0), (2, "b", 1, "main", T0, T0, T0), (3, "a", 1, "main", T0 + timedelta(1), T0, T0), (4, "c", 1, "adjudicator", T0 + timedelta(9), T0, T0), (5, "d", 2, "main", T0, T0, T0), (6, "e", 1, "main", None, None, None)], cols)
    chats = spark.createDataFrame([("a", 1), ("b", 1), ("new", 1), ("d", 2)], "native_id string, project_id bigint")
    assert {tuple(r) for r in serving.newest_activity(s, chats).collect()} == {("a", 1, 2), ("b", 1, 3), ("new", 1, 3)}


def test_first_interaction_reasons_in_order(spark):
    m = spark.createDataFrame([(i, i, 1 if i == 1 else 0, T0 if i == 5 else None) for i in range(1, 10)], "id bigint, session_id bigint, turn_index int, reingested_at timestamp")
    c = spark.createDataFrame([(i, i != 3, "q", " " if i == 7 else "a", 4 if i == 6 else 0, 2 if i == 4 else 3, T0 - timedelta(1)) for i in range(1, 9) if i != 2], "memory_id bigint, included boolean, user_prompt string, assistant_response string, omitted_before_chars bigint, filter_version int, captured_at timestamp")
    got = {r.session_id: r.reason for r in serving.first_interactions(m, c, 3).collect()}
    assert got == {1: "not_first", 2: "missing", 3: "excluded", 4: "outdated", 5: "superseded", 6: "truncated", 7: "blank", 8: None, 9: "missing"}


def test_markers_count_for_the_next_boundary_only(spark):
    rows = [("f", i, b, m) for i, (b, m) in enumerate([(False, True), (True, False), (True, False), (False, False), (False, True), (True, True), (True, False)])]
    got = serving.resume_markers(spark.createDataFrame(rows, "file string, pos int, boundary boolean, marker boolean"), "file", ["pos"])
    assert sorted((r.pos, r.marked) for r in got.collect()) == [(1, True), (2, False), (5, True), (6, False)]


def test_import_matches_by_the_surest_key(spark):
    cols = "id bigint, path string, git_root string, git_remote string, git_root_commit string"
    b = spark.createDataFrame([(1, "/x", "/r", "git@a", "c1"), (2, "/y", None, None, "c2"), (3, "/z", " ", "", None), (4, "/q", None, None, None)], cols)
    local = spark.createDataFrame([(11, "/x", None, None, None), (12, "/n", None, "git@a", None), (13, "/m", None, None, "c2"), (14, "/m2", None, None, "c2"), (15, "/z", None, None, None)], cols)
    got = {r.id: (r.rank, r.local_id, r.state) for r in upkeep.import_matches(b, local).collect()}
    assert got == {1: (1, 12, "matched"), 2: (2, 13, "ambiguous"), 3: (4, 15, "matched"), 4: (None, None, "unmatched")}


def test_receipts_requests_and_embeddings(spark):
    stored = spark.createDataFrame([("a", "x"), ("b", None)], "k string, body string")
    new = spark.createDataFrame([("a", "x"), ("b", None), ("c", "n"), ("d", "1"), ("d", "2")], "k string, body string")
    assert {tuple(r) for r in upkeep.outcomes(stored, new, ["k"], "body").collect()} == {("a", "duplicate"), ("b", "duplicate"), ("c", "stored"), ("d", "conflict")}
    assert {tuple(r) for r in upkeep.outcomes(stored, spark.createDataFrame([("a", "y")], "k string, body string"), ["k"], "body").collect()} == {("a", "conflict")}
    req = spark.createDataFrame([(1, 10), (2, 10)], "request_id int, issued_at int")
    att = spark.createDataFrame([(7, 1, 9), (8, 1, 12), (6, 1, 12), (5, 1, 20)], "attempt_id int, request_id int, at int")
    assert [tuple(r) for r in upkeep.consumed(req, att).collect()] == [(1, 6)]
    src = spark.createDataFrame([(1, " ", "h", 1), (2, "t", "h", 1), (3, "t", "h", 1), (4, "t", "h", 1), (5, "t", "h", 1)], "id bigint, source string, source_hash string, project_id bigint")
    v = spark.createDataFrame([(3, "h", 2), (4, "g", 1), (5, "h", 1)], "session_id bigint, source_hash string, project_id bigint")
    assert {r.id: r.status for r in upkeep.embedding_pass(src, v).collect()} == {1: "ineligible", 2: "missing", 3: "moved", 4: "changed", 5: "current"}


def test_rules_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(o, i, rnd.choice([None, " ", "x" * 301, "r" * rnd.randint(90, 299), f"rule {rnd.randint(0, 12)}", "same  rule"])) for o in range(6) for i in range(30)]
    got = {(r.o, r.i): r.outcome for r in upkeep.admitted_rules(spark.createDataFrame(rows, "o int, i int, t string"), "o", "i", "t").collect()}
    for o in range(6):
        kept = []
        for _, i, t in sorted(r for r in rows if r[0] == o):
            t = " ".join((t or "").split())
            want = "blank" if not t else "too_long" if len(t) > 300 else "duplicate" if t in kept else "too_many" if len(kept) == 8 else "over_total" if len("".join(kept)) + len(t) > 1200 else "admitted"
            kept += [t] if want == "admitted" else []
            assert got[o, i] == want


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(E.iso_millis(F.lit("1970-01-01T00:00:01.5Z"))) == 1500 and one(E.iso_millis(F.lit("01.01.1970"))) is None and one(E.iso_millis(F.lit("1970-13-01T00:00:00Z"))) is None and one(E.iso_millis(F.lit(None).cast("string"))) is None
    assert one(E.json_strings(F.lit('["a", 1, null, "b", ["c"]]'))) == ["a", "b"] and one(E.json_strings(F.lit("{}"))) == [] and one(E.json_strings(F.lit("no"))) == [] and one(E.json_strings(F.lit(None).cast("string"))) is None
    assert one(E.discriminator(F.lit("a\x1b[31mb"))) == "ab" and len(one(E.discriminator(F.lit("x" * 200)))) == 93 and one(E.fingerprint(F.lit("abc"))) == one(E.fingerprint(F.lit("zabc"), 3))


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id bigint, path string, git_root string, git_remote string, git_root_commit string, first_seen_at timestamp, last_seen_at timestamp")
    assert upkeep.import_matches(p, p).count() == 0
    r = spark.createDataFrame([], "o int, i int, t string")
    assert upkeep.admitted_rules(r, "o", "i", "t").count() == 0


def test_open_turns_at_the_end_of_files(spark):
    m = lambda n: T0 + timedelta(minutes=n)
    seen = spark.createDataFrame([(1, "a", m(0)), (1, "a", m(1)), (2, "a", m(0)), (3, "a", m(0)), (4, "a", m(58)), (5, "a", m(0))], "session_id int, source_id string, at timestamp")
    now = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "session_id int, source_id string")
    done = spark.createDataFrame([(1, m(0)), (2, m(3))], "session_id int, at timestamp")
    got = {r.session_id: (r.state, r.staged_at) for r in transcripts.staged_open_turns(seen, now, done, F.lit(m(60))).collect()}
    assert got == {1: ("open", m(1)), 2: ("closed", m(0)), 3: ("invalid", m(0)), 4: ("waiting", m(58)), 5: ("invalid", m(0))}


def test_summaries_since_the_last_compaction(spark):
    rows = [("a", 0, False, "old"), ("a", 1, True, None), ("a", 2, False, "new"), ("a", 3, False, "new"), ("b", 0, False, "x"), ("b", 1, False, "y"), ("c", 0, True, None), ("d", 0, False, " "), ("e", 0, False, "z" * 11), ("f", 0, True, "own")]
    got = {r.file: (r.state, r.summary) for r in transcripts.compact_summaries(spark.createDataFrame(rows, "file string, pos int, compacted boolean, summary string"), 10).collect()}
    assert got == {"a": ("found", "new"), "b": ("ambiguous", None), "c": ("none", None), "d": ("blank", None), "e": ("oversize", None), "f": ("found", "own")}

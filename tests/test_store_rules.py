"""Rules of the store, restated on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assemble, evidence, projects, retention, store
from tidemark.operators.ledger import oldest_first

T0 = datetime(2025, 6, 1)


def test_pending_roots_decide_nothing(spark):
    roots = [("/a", "approved", "scan", T0, 1), ("/a/b", "pending", "cli", T0, 2), ("/a/c", "denied", "scan", T0, 3), ("/a/c", "approved", "cli", T0 - timedelta(1), 4), ("/p", "pending", "cli", T0, 5)]
    r = spark.createDataFrame(roots, "root string, state string, source string, decided_at timestamp, ulid int")
    p = spark.createDataFrame([("/a/b/x",), ("/a/c/x",), ("/p/x",), ("/ab",), ("/a",)], "path string")
    assert {tuple(x) for x in projects.consent(p, r).collect()} == {("/a/b/x", "approved"), ("/a/c/x", "approved"), ("/p/x", "pending"), ("/ab", "pending"), ("/a", "approved")}


@pytest.mark.parametrize("prompt,calls,kept", [("please hold off", 0, False), ("Pause here.", 0, False), ("Don't touch anything yet", 0, False), ("no hagas nada de momento", 0, False), ("hold off", 1, True), ("the pause button", 0, True), ("pause", 0, True), (None, 0, True), ("<oai-mem-citation>hold off</oai-mem-citation> go on", 0, True)])
def test_pauses(spark, prompt, calls, kept):
    t = spark.createDataFrame([(1, prompt, "ok <citation>x</citation>", [("edit", ["f"])] * calls)], "memory_id int, user_prompt string, assistant_response string, tool_calls array<struct<name:string,file_paths:array<string>>>")
    got = assemble.projection(t).collect()
    assert len(got) == kept and all(r.reply == "ok <citation>x</citation>" for r in got)


def test_what_makes_a_session_substantive(spark):
    s = spark.createDataFrame([(i, "codex", f"n{i}", 0, 1, None, "t", None, T0, T0, T0, "main") for i in range(6)], "id bigint, tool string, native_id string, segment_index int, project_id bigint, custom_title string, title string, surface string, started_at timestamp, last_ingested_at timestamp, last_turn_at timestamp, kind string")
    one = lambda i, s, t, files=(), notes=0: (i, s, t, None, list(files), [("w", "y")] * notes)
    m = spark.createDataFrame([one(1, 0, 0, notes=3), one(2, 1, 0), one(3, 1, 1), one(4, 2, 0, ["f"]), one(5, 3, 0), one(6, 3, 1), one(7, 4, 0)], "id bigint, session_id bigint, turn_index int, reingested_at timestamp, files_touched array<string>, decisions array<struct<what:string,why:string>>")
    rolled = spark.createDataFrame([(3, 0), (4, 2)], "id bigint, notes bigint")
    got = {r.id: r.substantive for r in store.served_sessions(s, m, rolled, spark.createDataFrame([(5,)], "id bigint")).collect()}
    # decisions count only in a rollup, and where there is one, turns do not
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: True}


def test_capture_and_coverage(spark):
    m = spark.createDataFrame([(i, s, i, r) for i, s, r in [(1, 1, None), (2, 1, T0), (3, 2, T0), (4, 3, None), (5, 4, None), (6, 5, None), (7, 6, None)]], "id bigint, session_id bigint, turn_index int, reingested_at timestamp")
    c = spark.createDataFrame([(1, True, "a", 0, 3, T0), (2, True, "a", 0, 3, T0), (3, True, "a", 0, 3, T0 - timedelta(1)), (4, True, "a", 5, 3, T0), (6, True, "a", 0, 2, T0), (7, True, "a", 0, 3, T0)], "memory_id bigint, included boolean, user_prompt string, omitted_before_chars bigint, filter_version int, captured_at timestamp")
    states = store.copy_state(m, c, 3)
    assert {r.id: r.state for r in states.collect()} == {1: "current", 2: "current", 3: "superseded", 4: "current", 5: "missing", 6: "outdated", 7: "current"}
    cap = store.capture_states(states, spark.createDataFrame([(6,)], "session_id bigint"))
    assert {r.session_id: r.state for r in cap.collect()} == {1: "complete", 2: "disabled_gap", 3: "complete_truncated", 4: "disabled_gap", 5: "disabled_gap", 6: "parse_error"}
    cov = store.session_coverage(cap, spark.createDataFrame([(5,)], "session_id bigint"))
    assert {r.session_id: r.bucket for r in cov.collect()} == {1: "complete", 2: "incomplete", 3: "complete_truncated", 4: "never", 5: "evicted", 6: "incomplete"}


def test_eligibility_in_order(spark):
    now = datetime(2025, 6, 10)
    names = ["own", "open", "gap", "homeless", "parent", "fresh", "unsettled", "fine"]
    s = spark.createDataFrame([(i, "codex", n, None if n == "homeless" else 2 if n == "unsettled" else 1, now if n in ("fresh", "own") else T0) for i, n in enumerate(names)], "id bigint, tool string, native_id string, project_id bigint, last_ingested_at timestamp")
    chats = lambda *x: spark.createDataFrame([("codex", n) for n in x], "tool string, native_id string")
    cap = spark.createDataFrame([(i, "disabled_gap" if n == "gap" else "complete") for i, n in enumerate(names)], "session_id bigint, state string")
    p = spark.createDataFrame([(1, "/a"), (2, "/b")], "id bigint, path string")
    consent = spark.createDataFrame([("/a", "approved"), ("/b", "pending")], "path string, state string")
    got = retention.eligibility(s, cap, chats("open", "own"), p, consent, chats("parent"), F.lit(now), ("codex", "own"))
    assert {r.native_id: r.ineligible for r in got.collect()} == {"own": "active_writer", "open": "open_turn", "gap": "capture_incomplete", "homeless": "identity_uncertain", "parent": "identity_uncertain", "fresh": "active_writer", "unsettled": "consent_unsettled", "fine": None}


def test_plans(spark):
    u = spark.createDataFrame([("a", str(i), 100, T0 + timedelta(i)) for i in range(10)], "tool string, native_id string, bytes bigint, started_at timestamp_ntz")
    e = spark.createDataFrame([("a", str(i), "open_turn" if i in (0, 2) else None) for i in range(10)], "tool string, native_id string, ineligible string")
    of = lambda **k: retention.plan(u, e, stored=1000, capacity=1000, warning=800, target=950, **k)
    assert of(before=900, write=50)[0] == "within_capacity" and of(before=700, write=400)[0] == "unwarned_jump" and of(before=950, write=900)[0] == "target_unreachable"
    how, taken = of(before=950, write=150)
    assert how == "cleanup" and sorted(r.native_id for r in taken.collect()) == ["1", "3"]


def test_warnings_against_a_loop(spark):
    rnd = random.Random(4)
    rows = [(k, T0 + timedelta(hours=h * 11), rnd.choice([100, 790, 850, 900, 960, None])) for k in ("a", "b") for h in range(150)]
    got = {(r.k, r.at): r.due for r in retention.warnings(spark.createDataFrame(rows, "k string, at timestamp, used bigint"), "k", "at", "used", 800, 950).collect()}
    for k in ("a", "b"):
        last = None
        for _, at, used in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want = None
            if used is None or used < 800:
                last = None
            elif used >= 950 or last is None or at - last >= timedelta(days=7):
                want, last = "urgent" if used >= 950 else "weekly", at
            assert got[k, at] == want


def test_orphans(spark):
    p = spark.createDataFrame([(1, "/here", None), (2, "/gone", None), (3, "/moved", "/root"), (4, "/odd", None), (5, "/gone2", "/gone2")], "id bigint, path string, git_root string")
    seen = spark.createDataFrame([("/here", "directory"), ("/gone", "missing"), ("/gone2", "missing"), ("/moved", "missing"), ("/root", "directory"), ("/odd", "unresolved")], "path string, state string")
    src = spark.createDataFrame([("s", "file"), ("lost", "missing"), ("dim", "unresolved")], "path string, state string")
    chats = {"stays": [(1, "s")], "orphan": [(2, "s")], "orphan2": [(5, "s"), (2, "s")], "moved": [(3, "s")], "odd": [(4, "s")], "unknown": [(9, "s")], "split": [(1, "s"), (1, "t")], "half": [(1, "s"), (2, "s")], "two": [(1, "s"), (3, "s")], "lost": [(1, "lost")], "kept": [(1, "lost")], "dim": [(1, "dim")]}
    s = spark.createDataFrame([("codex", n, o, f) for n, rows in chats.items() for o, f in rows], "tool string, native_id string, project_id bigint, source_path string")
    got = {r.native_id: r.outcome for r in retention.orphans(s, p, seen, src, spark.createDataFrame([("codex", "kept")], "tool string, native_id string")).collect()}
    assert got == {"stays": "associated", "orphan": "candidate", "orphan2": "candidate", "moved": "relocated", "odd": "unresolved", "unknown": "unresolved", "split": "unresolved", "half": "mixed", "two": "mixed", "lost": "candidate", "kept": "associated", "dim": "unresolved"}


def test_referenced_parents(spark):
    s = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "id bigint, tool string, native_id string")
    links = spark.createDataFrame([(2, 1), (3, 1), (3, None)], "session_id bigint, parent_id bigint")
    assert [tuple(r) for r in retention.referenced_parents(s, links).collect()] == [("a", "x")]


def test_session_evidence_stops_at_the_first_that_does_not_fit(spark):
    u = spark.createDataFrame([(1, i, t) for i, t in enumerate(["one", "two lease", "x" * 300, "four"])] + [(2, 0, "y" * 900), (3, 0, "only")], "id int, pos int, unit string")
    got = {r.id: (r.text, r.omitted) for r in evidence.session_evidence(u, ["lease"], 250).collect()}
    assert got == {1: ("two lease\n\none\n\n" + evidence.OMITTED_AFTER, 2), 3: ("only", 0)}


def test_names_are_looked_up_by_rank(spark):
    p = spark.createDataFrame([(1, "/a/web", "/a", "git@x", "Web"), (2, "/b/WEB", None, None, None), (3, "/c/site", "/a/web", None, "Site"), (4, "/d/website", None, None, None)], "id bigint, path string, git_root string, git_remote string, display_name string")
    q = spark.createDataFrame([("/a/web",), ("web",), ("git@x",), ("sit",), ("none",), (None,)], "query string")
    assert {tuple(r) for r in projects.resolve(p, q).collect()} == {("/a/web", 1, 1), ("web", 4, 1), ("web", 4, 2), ("git@x", 3, 1), ("sit", 5, 3), ("sit", 5, 4)}

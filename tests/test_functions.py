import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions import shell, titles
from tidemark.operators import dedupe, recall, rollups, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)


@pytest.mark.parametrize("f,arg,want", [
    (E.trimmed, " \n a b\t ", "a b"), (E.normalized, " A\n\n B ", "a b"), (E.blank, None, True), (E.blank, " \n", True), (E.folded, "fooBar HTTPServer x", "foo bar http server x"), (E.utf8_bytes, "é😀", 6), (E.utf8_bytes, None, 0),
    (E.utf16_units, "a😀", 3), (E.without_control, "\x1b[31mred\x1b[0m\x07", "red"), (E.json_length, "[1,2]", 2), (E.json_length, "{}", 0), (E.json_length, "{", None), (E.protected_array, "[]", False), (E.protected_array, "", False), (E.protected_array, "x", True), (E.protected_array, '["a"]', True),
])
def test_expressions(spark, f, arg, want):
    assert one(spark, f(lit(arg))) == want


def test_tokens_paths_and_ids(spark):
    assert one(spark, E.lexical_tokens(F.lit("See a/b_c.py now"))) == ["a/b_c.py", "see", "a", "b", "c", "py", "now"]
    assert one(spark, E.within(F.lit("/a/bc"), F.lit("/a/b"))) is False and one(spark, E.within(F.lit("/a/b/c"), F.lit("/a/b/"))) is True
    assert one(spark, E.patch_paths(F.lit("*** Begin\n*** Update File: a/b.py\n@@\n*** Add File: c.md\n*** Update File: a/b.py\n"))) == ["a/b.py", "c.md"]
    assert one(spark, E.public_id_parts(E.public_id(F.lit("codex"), F.lit("ü?"), F.lit(3)))) == ["codex", "ü?", "3"]


def test_budgets(spark):
    assert one(spark, E.bounded_tail(F.lit("aaaa bbbb cccc"), 7)) == "cccc" and one(spark, E.bounded_tail(F.lit("abcdefgh"), 3)) == "fgh" and one(spark, E.bounded_tail(F.lit("abc"), 3)) == "abc"
    assert one(spark, E.head_and_tail(F.lit("a" * 10 + "b" * 20), 9)) == "aaa\n[... 21 characters omitted ...]\nbbbbbb"
    assert one(spark, E.snippet(F.lit("xx Needle yy"), F.lit("needle"), 2, 8)) == "x Needle y"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, E.cosine(v(1, 0), v(2, 0))) == 1.0 and one(spark, E.cosine(v(0, 0), v(1, 0))) is None and one(spark, E.usable(v(1, 2), F.lit(2))) is True and one(spark, E.usable(v(0, 0), F.lit(2))) is False and one(spark, E.usable(v(1, float("nan")), F.lit(2))) is False


@pytest.mark.parametrize("text,strip,escape", [
    ("plain", "plain", "plain"), ("$(rm x)", "rm x", "$\\(rm x)"), ("`a` $($(b))", "a b", "\\`a\\` $\\($\\(b))"), ("\\`a\\`", None, "\\`a\\`"), ("cost $5", "cost $5", "cost $5"), ("cat <<EOF", "cat EOF", "cat <\\<EOF"), ("${HOME}/x", "HOME/x", "$\\{HOME}/x"),
    ("diff <(a) >(b (c))", "diff a b (c)", "diff <\\(a) >\\(b (c))"), ("a\n  && make; b", "a\n   make; b", "a\n  \\&\\& make; b"), ("a\n\\&& b", "a\n b", "a\n\\&\\& b"), ("Tom & Jerry; x", "Tom & Jerry; x", "Tom & Jerry; x"), ("a \x1b]0;t\x07b\x1b[31mc\rd", "a bcd", "a bcd"),
    ("cat <<EOF && rm x; $(a", "cat EOF && rm x; a", "cat <\\<EOF && rm x; $\\(a")])
def test_shell(text, strip, escape):
    assert strip is None or shell.stripped(text) == strip
    assert shell.escaped(text) == escape and not shell.detected(escape)


@pytest.mark.parametrize("text,want", [("first\n| grep x", True), ("first\n  ; rm", True), ("x\n|| true", True), ("& disown", True), ("first\n\\&& make", True), ("a\x00b", True), ("a\rb", True), ("cat <<< x", True), ("first; then second", False), ("a < b and b > c", False),
                                       ("run \\`date\\` first", False), ("first\n\\&\\& make", False), ("one\n\tindented", False), ("", False)])
def test_shell_is_detected(text, want):
    assert shell.detected(text) is want


@given(st.text(alphabet="$(){}`\\a<>&|", max_size=30))
def test_shell_is_idempotent(text):
    assert shell.escaped(shell.escaped(text)) == shell.escaped(text) and not shell.detected(shell.escaped(text))
    assert not shell.detected(shell.stripped(shell.stripped(text))) or "\\" in text


def test_shell_column(spark):
    df = spark.createDataFrame([("$(a)",), ("b",), (None,)], "t string")
    assert [tuple(r) for r in df.select(shell.has_shell(F.col("t")), shell.escape_shell(F.col("t"))).collect()] == [(True, "$\\(a)"), (False, "b"), (False, None)]


@pytest.mark.parametrize("prompt,want", [(None, None), ("```\n## Fix the **login** page of the shop\nmore", "Fix the login page of the shop"), ("ok", "ok"), ("---\n{}", None), ("word " * 40, "word " * 13 + "word…")])
def test_titles(prompt, want):
    assert titles.title(prompt) == want


def test_units_and_evidence():
    assert titles.units("One. Two is here.\n\nThe list:\n\n- a\n\n- b") == ["One.", "Two is here.", "The list:\n\n- a\n\n- b"]
    assert titles.units("Never do this:\n\nDelete it.") == ["Never do this:\n\nDelete it."] and titles.units("See\n\n1. a") == ["See\n\n1. a"] and titles.units(" \n") == [] and titles.units(None) == []
    assert titles.pack_evidence(["first unit", "second"], 60) == ("first unit\n\nsecond", 0) and titles.pack_evidence(["first unit", "second"], 40) is None and titles.pack_evidence(["x" * 50], 40) is None and titles.pack_evidence([], 40) is None
    assert titles.pack_evidence(["a", "b" * 90, "c"], 80) == ("a\n\n" + titles.OMITTED_AFTER, 2) and titles.pack_evidence(["a"], 80, omitted_before=True) == (titles.OMITTED_BEFORE + "\n\na", 0)


def test_near_verbatim(spark):
    body = "The quick brown fox jumps over the lazy dog and runs away\nshort"
    f = lambda t, b: one(spark, dedupe.near_verbatim(lit(t), lit(b)))
    assert f("x the quick brown  fox jumps over the LAZY dog and runs away y", body) is True
    assert f("the quick brown fox jumps over the lazy dog", body) is True and f("something else entirely different", body) is False and f("short", "short") is False and f("", body) is False and f(None, body) is False


def test_digest(spark):
    assert one(spark, dedupe.digest(lit("a"), lit(None))) == hashlib.sha256(b"1:a|-").hexdigest()
    assert one(spark, dedupe.digest(lit(""), lit("b"))) != one(spark, dedupe.digest(lit(None), lit("b")))


def test_retraction(spark):
    old = spark.createDataFrame([("c", i, f"d{i}") for i in range(4)] + [("e", 0, "x")], "chat string, turn int, d string")
    new = spark.createDataFrame([("c", 0, "d0"), ("c", 1, "d1"), ("c", 2, "new"), ("c", 3, "d3"), ("e", 0, "x"), ("e", 1, "y")], "chat string, turn int, d string")
    kept = dedupe.retract(old, dedupe.first_changes(old, new, "chat", "turn", "d"), "chat", "turn")
    assert sorted((r.chat, r.turn) for r in kept.collect()) == [("c", 0), ("c", 1), ("e", 0)]


def test_packing(spark):
    rows = [("k", i, s) for i, s in enumerate([3, 4, 4, 9, 12, 1, 1])]
    got = rollups.pack(spark.createDataFrame(rows, "k string, i int, s int"), "k", ["i"], "s", 10)
    assert [r.batch for r in got.orderBy("i").collect()] == [0, 0, 1, 2, 3, 4, 4]


def test_rollup_keeps_first_wording_and_last_open_items(spark):
    schema = "id bigint, session_id bigint, turn_index int, decisions array<struct<what:string,why:string>>, pending_items array<string>, files_touched array<string>"
    m = spark.createDataFrame([(1, 1, 0, [("Use X ", "fast"), ("", None)], ["a", "b"], ["f"]), (2, 1, 1, [("use x", None), ("Drop Y", " ")], ["c"], ["f", "g"]), (3, 2, 0, None, None, None)], schema)
    assert {(r.what, r.why, r.turn_index, r.times) for r in rollups.merged_decisions(m).collect()} == {("Use X ", "fast", 0, 2), ("Drop Y", None, 1, 1)}
    assert {tuple(r) for r in rollups.rollup(m).collect()} == {(1, 2, 1, 2, 2, 1), (2, 1, 0, 0, 0, 0)}


def test_advance_needs_the_expected_turn(spark):
    r = spark.createDataFrame([(1, 3), (2, 5)], "session_id int, through int")
    b = spark.createDataFrame([(1, 4, 3), (2, 9, 4), (3, 0, None)], "session_id int, through int, expected int")
    assert {tuple(x) for x in rollups.advance(r, b).collect()} == {(1, 4), (2, 5), (3, 0)}


def test_recall(spark):
    rows = [(1, "Lease queue", "x", None, 1), (2, "other", "the lease queue here", None, 2), (3, None, None, None, 3), (4, "lease", None, None, 4), (5, "none", "none", None, 5), (6, None, None, "queue the lease", 6)]
    s = spark.createDataFrame(rows, "id bigint, title string, prompt string, rollup string, ended_at bigint")
    c = spark.createDataFrame([(3, "about a queue"), (3, "and a lease")], "id bigint, text string")
    got = recall.recall(s, c, "the lease queue").collect()
    assert [r.id for r in got] == [1, 2, 6, 3] and [r.tier for r in got] == [12_000, 10_000, 6_000, 4_500]
    assert recall.recall(s, c, "absent").collect() == [] and recall.recall(s, c, "please the").collect() == []
    assert [r.id for r in recall.recall(s, c, "lease absent", strict=True).collect()] == []  # no hit reaches the rarest token's weight
    assert recall.query_tokens("What about the fooBar?") == ["what", "foo", "bar"] and recall.query_tokens("the") == [] and recall.question("Please, the to") is None
    q = recall.question("the lease_queue/x in fooBar ﬁle")
    assert q.components == ("lease", "queue", "x", "in", "foo", "bar", "file") and q.tokens == ("lease_queue/x", "lease", "queue", "x", "in", "foo", "bar", "file")
    assert len(recall.query_tokens(" ".join(f"w{i}" for i in range(300)))) == 300


def test_one_token_is_too_few_beside_two(spark):
    s = spark.createDataFrame([(i, t, None, None, i) for i, t in enumerate(["alpha beta", "alpha", "beta", "other", "more"])], "id bigint, title string, prompt string, rollup string, ended_at bigint")
    c = spark.createDataFrame([], "id bigint, text string")
    assert [r.id for r in recall.recall(s, c, "alpha beta", strict=False).collect()] == [0]


def test_best_score_by_session(spark):
    t = spark.createDataFrame([(1, "queue queue x"), (1, "nothing here"), (2, "queue and a long text with other words"), (3, "none"), (4, "none"), (5, "none")], "id bigint, text string")
    got = {r.id: r.bm25 for r in recall.bm25_by_session(t, "the queue").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0 and recall.bm25_by_session(t, "the").collect() == []


def test_decisions_go_to_their_turns(spark):
    d = spark.createDataFrame([(1, "a", "Use sqlite for storage", 7), (1, "b", "use the sqlite storage layer", 99), (1, "c", "something else entirely", None), (1, "d", "is it in on of", None), (2, "e", "alpha", None)], "session_id int, key string, what string, claimed int")
    t = spark.createDataFrame([(1, 3, ["picked sqlite as storage", "x"]), (1, 5, ["storage layer: sqlite"]), (1, 7, None), (2, 1, [])], "session_id int, turn_index int, decisions array<string>")
    assert sorted(tuple(r) for r in rollups.attribute(d, t).collect()) == [(1, "a", 7, "claimed"), (1, "b", 5, "matched"), (1, "c", 7, "last"), (1, "d", 7, "last"), (2, "e", 1, "last")]


def test_windows_of_time():
    from datetime import datetime, timedelta

    now = datetime(2025, 1, 8)
    assert stats.since("7d", now) == now - timedelta(days=7) and stats.since("2025-01-01", now) == datetime(2025, 1, 1)

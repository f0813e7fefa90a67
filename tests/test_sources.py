import json

import pytest

from tidemark.operators.assemble import assemble
from tidemark.sources import records as R


def write(path, rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + tail)


ONE = [
    {"type": "user", "timestamp": "2025-01-01T10:00:00Z", "cwd": "/w/a", "gitBranch": "main", "message": {"role": "user", "content": "  first prompt "}},
    {"type": "assistant", "timestamp": "2025-01-01T10:00:05Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "an answer"}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {}}]}},
    {"type": "user", "timestamp": "2025-01-01T10:00:06Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "done"}]}},
    {"type": "assistant", "timestamp": "2025-01-01T10:00:09Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "and more"}]}},
    "{ broken", {"type": "alien"}, {"type": "system", "text": "x"},
    {"type": "user", "timestamp": "2025-01-01T11:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "second"}]}},
]
TWO = [
    {"type": "session_meta", "payload": {"cwd": "/w/b", "git": {"branch": "dev"}}},
    {"type": "event_msg", "timestamp": "2025-02-01T10:00:00Z", "payload": {"type": "user_message", "message": "ask"}},
    {"type": "response_item", "timestamp": "2025-02-01T10:00:01Z", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "reply"}]}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "x"}},
]


def test_both_formats_to_turns(spark, tmp_path):
    write(tmp_path / "p" / "one.jsonl", ONE, tail='{"type": "user"')
    write(tmp_path / "q" / "two.jsonl", TWO)
    r = R.records(R.lines(spark, str(tmp_path))).cache()
    kinds = {f: [x.kind for x in sorted((x for x in r.collect() if x.file.endswith(f)), key=lambda x: x.pos)] for f in ("one.jsonl", "two.jsonl")}
    assert kinds["one.jsonl"] == ["boundary", "content", "skip", "content", "malformed", "unrecognized", "skip", "boundary"]
    assert kinds["two.jsonl"] == ["skip", "boundary", "content", "skip"]
    turns = sorted((x.file[-9:], x.turn_index, x.user_text, x.assistant_text) for x in assemble(r.where("kind in ('boundary', 'content', 'skip')")).collect())
    assert turns == [("one.jsonl", 0, "first prompt", "an answer\nand more"), ("one.jsonl", 1, "second", ""), ("two.jsonl", 0, "ask", "reply")]
    k = {x.file[-9:]: x for x in R.session_kind(r).collect()}
    assert (k["one.jsonl"].malformed, k["one.jsonl"].unrecognized, k["one.jsonl"].state, k["one.jsonl"].cwd) == (1, 1, "turns", "/w/a")
    assert {x.root for x in R.discovered(r, "t").collect()} == {"/w/a", "/w/b"}


def test_tail_reads_each_appended_line_once(spark, tmp_path):
    spark.dataSource.register(R.TailSource)
    src, out = tmp_path / "in", str(tmp_path / "out")
    write(src / "a.jsonl", ["1", "2"], tail="3")

    def run():
        q = spark.readStream.format("jsonl-tail").option("path", str(src)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert run() == ["1", "2"]
    with (src / "a.jsonl").open("a") as f:
        f.write("3\n4\n")
    write(src / "b.jsonl", ["5"])
    assert run() == ["1", "2", "33", "4", "5"]
    write(src / "a.jsonl", ["1"])
    with pytest.raises(Exception, match="shorter"):
        run()


def test_call_log(spark, tmp_path):
    df = spark.createDataFrame([("a", True, "2025-01-01"), ("b", False, "2025-01-05")], "name string, ok boolean, d string").selectExpr("name", "ok", "cast(d as date) day")
    R.write_calls(df, str(tmp_path / "calls"))
    assert [r.name for r in R.read_calls(spark, str(tmp_path / "calls"), "name string, ok boolean", "2025-01-02").collect()] == ["b"]


def test_tail_refuses_files_rewritten_as_long_or_longer_and_passes_over_long_records(tmp_path):
    from tidemark.sources.records import _TailReader

    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"a":1}\n{"a":2}\n{"unfinished')
    reader = _TailReader({"path": str(tmp_path), "maxrecordbytes": "20"})
    first = reader.latestOffset()
    (part,) = reader.partitions({}, first)
    assert [r[1:] for r in reader.read(part)] == [(0, '{"a":1}'), (8, '{"a":2}')]
    with p.open("ab") as f:
        f.write(b'": 3}\n' + b"x" * 3_000_000 + b'\n{"a":4}\n')
    second = reader.latestOffset()
    (part,) = reader.partitions(first, second)
    assert [r[2] for r in reader.read(part)] == ['{"unfinished": 3}', None, '{"a":4}']
    assert reader.partitions(second, second) == []
    p.write_bytes(b'{"b":1}\n' + p.read_bytes()[8:] + b'{"b":5}\n')
    reader.partitions(second, _TailReader({"path": str(tmp_path)}).latestOffset())  # only the bytes before the offset are fingerprinted
    p.write_bytes(p.read_bytes().replace(b'{"a":4}', b'{"z":4}'))
    with pytest.raises(ValueError, match="rewritten"):
        reader.partitions(second, _TailReader({"path": str(tmp_path)}).latestOffset())

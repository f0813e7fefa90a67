"""Transcript sources: JSON lines of two tools, read as one kind of records.

``records`` keeps every line: what cannot be parsed or is of no known type is
kind ``malformed`` or ``unrecognized`` and counted, never dropped in silence.
Lines are numbered within their file, by which turns are assembled later.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.functions import expr as E

#: Longest record that is read, in bytes.
RECORD_BYTES = 64 << 20
#: Bytes before an offset that are fingerprinted, and bytes looked at together.
FINGERPRINT_BYTES, CHUNK_BYTES = 4096, 1 << 20
#: Record types of the two formats that carry no text of a turn.
SKIPPED = ("system", "ai-title", "custom-title", "summary", "progress", "file-history-snapshot", "queue-operation", "session_meta", "turn_context", "compacted")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, value``: the lines of text files with their number in the file.

    Files are the unit of work (a line has no offset of its own in Spark's text
    source), so a file is one row of its bytes split here; tools write many
    files of moderate size. Of records over ``RECORD_BYTES``
    the value is null, so that they count as malformed.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)
    whole = F.split(F.decode("content", "UTF-8"), "\n")
    # the last piece follows the last line break: a record still being written
    done = F.slice(whole, 1, F.greatest(F.lit(0), F.size(whole) - 1))
    return (raw.select(F.col("path").alias("file"), F.posexplode(done).alias("pos", "value")).where(F.trim("value") != "")
            .withColumn("value", F.when(F.octet_length("value") <= RECORD_BYTES, F.col("value"))))


def _text(content: Column) -> Column:
    """Text of a message whose content is a string or a list of blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(E.trimmed(content).startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["type"], F.lit("")).isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")).otherwise(content)


def records(rows: DataFrame) -> DataFrame:
    """``file, pos, kind, role, ts, text, cwd, branch`` of the lines of either format.

    A line of the first format has ``type`` user or assistant and ``message``;
    of the second, ``type`` event_msg or response_item and ``payload``. User
    texts open turns (``boundary``), answers are ``content``; results of tools,
    summaries and metadata are ``skip``.
    """
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    r = rows.withColumns({"type": get("$.type"), "sub": get("$.payload.type"), "role0": F.coalesce(get("$.message.role"), get("$.payload.role"), get("$.type")), "meta": F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)),
                          "content": F.coalesce(F.to_json(F.try_variant_get(v, "$.message.content", "variant")), F.to_json(F.try_variant_get(v, "$.payload.content", "variant"))), "plain": F.coalesce(get("$.message.content"), get("$.payload.message"))})
    text = F.when(F.col("content").startswith("["), _text(F.col("content"))).otherwise(F.col("plain"))
    r = r.withColumn("text", text)
    said = ~E.blank("text") & ~F.col("meta")
    one = F.col("type").isin("user", "assistant")
    two = F.col("type").isin("event_msg", "response_item")
    kind = (F.when(v.isNull(), "malformed")
            .when(one & said & (F.col("role0") == "user"), "boundary").when(one & said, "content").when(one, "skip")
            .when(two & (F.col("sub") == "user_message") & said, "boundary").when(two & (F.col("sub") == "message") & (F.col("role0") == "assistant") & said, "content").when(two, "skip")
            .when(F.col("type").isin(*SKIPPED), "skip").otherwise("unrecognized"))
    role = F.when(kind == "boundary", "user").when(kind == "content", "assistant")
    return r.select("file", "pos", kind.alias("kind"), role.alias("role"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), F.when(role.isNotNull(), F.col("text")).alias("text"),
                    F.coalesce(get("$.cwd"), get("$.payload.cwd")).alias("cwd"), F.coalesce(get("$.gitBranch"), get("$.payload.git.branch")).alias("branch"))


def session_kind(records_: DataFrame) -> DataFrame:
    """Per file what it is: ``empty``, ``malformed``, ``no_turns`` or ``turns``, with its first directory and its counts."""
    g = records_.groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "unrecognized").alias("unrecognized"), F.count_if(F.col("kind") == "boundary").alias("turns"),
                                     F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("pos"))).alias("cwd"))
    state = F.when(F.col("records") == 0, "empty").when(F.col("turns") > 0, "turns").when(F.col("malformed") > 0, "malformed").otherwise("no_turns")
    return g.withColumn("state", state)


def discovered(records_: DataFrame, tool: str) -> DataFrame:
    """Per project directory: tools, files, first and last record."""
    per = records_.groupBy("file").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("pos"))).alias("root"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    return per.where("root is not null").groupBy("root").agg(F.array(F.lit(tool)).alias("tools"), F.count("*").alias("sessions"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _mark(f, offset: int) -> str:
    """An offset with the fingerprint of what stands before it."""
    f.seek(max(0, offset - FINGERPRINT_BYTES))
    return f"{offset}:{hashlib.sha256(f.read(min(offset, FINGERPRINT_BYTES))).hexdigest()}"


def _offset(mark: str | None) -> int:
    return int(mark.split(":")[0]) if mark else 0


class _TailReader(DataSourceStreamReader):
    """Reads what was appended to files since the last batch.

    An offset says of each file how many bytes were read and holds a fingerprint
    of the last of them. A file that is shorter, or that holds others there, was
    rewritten and is refused: its records would be read from the middle.
    """

    def __init__(self, options: dict):
        self.folder = Path(options["path"])
        self.limit = int(options.get("maxrecordbytes", RECORD_BYTES))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for p in sorted(self.folder.rglob("*.jsonl")):
            with p.open("rb") as f:
                end = self._last_line_break(f, p.stat().st_size, self.seen.get(str(p), 0))
                self.seen[str(p)] = end
                out[str(p)] = _mark(f, end)
        return out

    @staticmethod
    def _last_line_break(f, size: int, known: int) -> int:
        """Up to the last line break, as an unfinished line is left for later; looked for backwards, a chunk at a time, down to what is known."""
        stop = size
        while stop > known:
            start = max(known, stop - CHUNK_BYTES)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
        return min(known, size)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, mark in end.items():
            begin, stop = _offset(start.get(path)), _offset(mark)
            with open(path, "rb") as f:
                if stop < begin or f.seek(0, 2) < stop:
                    raise ValueError(f"{path} is shorter than what was read of it; it must be read anew under a new checkpoint")
                if begin and _mark(f, begin) != start[path]:
                    raise ValueError(f"{path} was rewritten since it was read; it must be read anew under a new checkpoint")
            if stop > begin:
                parts.append(_Range(path, begin, stop))
        return parts

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            at = partition.begin
            while at < partition.end:
                raw = f.readline(self.limit + 1)
                size = len(raw)
                if size > self.limit:  # too long: passed over in pieces, and counted as malformed
                    while not raw.endswith(b"\n") and (raw := f.readline(CHUNK_BYTES)):
                        size += len(raw)
                    yield partition.path, at, None
                elif raw.strip():
                    yield partition.path, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
                at += size

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("jsonl-tail")``: lines appended to the ``.jsonl`` files under ``path``, each once."""

    @classmethod
    def name(cls) -> str:
        return "jsonl-tail"

    def schema(self) -> str:
        return "file string, pos bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options)


def write_calls(calls: DataFrame, path: str, day: str = "day") -> None:
    """Append call records as JSON, a folder a day."""
    calls.write.mode("append").partitionBy(day).json(path)


def read_calls(spark: SparkSession, path: str, schema: str, since: str, day: str = "day") -> DataFrame:
    """Call records since a day; older folders are not opened."""
    return spark.read.schema(f"{schema}, {day} date").json(path).where(F.col(day) >= F.lit(since).cast("date"))


def parse_line(raw: str) -> dict | None:
    """One line as an object, or None."""
    try:
        v = json.loads(raw)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None

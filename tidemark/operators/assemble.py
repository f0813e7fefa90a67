"""Records to turns: boundaries open turns, content is folded in, context is carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E

#: Turns whose text holds this mark were put there by the system itself.
SENTINEL = "[[session-memory:"
#: The tag of blocks that cite injected memory and are not kept, and how a prompt asks to do nothing.
CITATION = "oai-mem-citation"
PAUSE = r"(?i)\b(?:no\s+(?:hagas?|hacer|toques?)\s+nada(?:\s+de\s+momento)?|do(?:n't| not)\s+(?:do|change|touch)\s+anything|hold\s+off|pause\s+here|wait\s+for\s+now)\b"


def assemble(records: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Turns of ordered records (``file, pos, kind, role, ts, text``).

    kind is ``boundary`` (opens a turn), ``content`` or ``skip``. Content before
    the first boundary is dropped, as are turns without any text; they take no
    index. Texts are trimmed and joined by line breaks. One shuffle on the file
    serves the numbering and the grouping.
    """
    w = Window.partitionBy(file).orderBy(pos)
    r = records.where("kind <> 'skip'").withColumn("grp", F.sum((F.col("kind") == "boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("grp > 0")
    part = F.when(~E.blank("text"), F.struct(F.col(pos).alias("p"), E.trimmed("text").alias("t")))
    join = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, part))), lambda x: x["t"]), "\n")
    t = r.groupBy(file, "grp").agg(F.min(pos).alias("first_pos"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col(pos))).alias("started_at"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col(pos))).alias("ended_at"),
                                   join("user").alias("user_text"), join("assistant").alias("assistant_text"))
    t = t.where((F.col("user_text") != "") | (F.col("assistant_text") != ""))
    return t.withColumn("turn_index", (F.row_number().over(Window.partitionBy(file).orderBy("grp")) - 1).cast("int")).drop("grp")


def carried(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last known value of each column, as of each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def accounting(records: DataFrame, raw: str, known: list[str]) -> DataFrame:
    """Per file: records, those that are no JSON, and those of an unknown type; nothing is dropped in silence."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    return records.groupBy("file").agg(F.count("*").alias("records"), F.count_if(v.isNull()).alias("malformed"), F.count_if(v.isNotNull() & ~F.coalesce(kind, F.lit("")).isin(known)).alias("unrecognized"))


def projection(turns: DataFrame) -> DataFrame:
    """Turns as they are kept: citation blocks off, tool calls only with paths, turns that ask to pause and call nothing left out."""
    strip = lambda c: E.trimmed(F.regexp_replace(c, rf"(?s)<{CITATION}>.*?</{CITATION}>", ""))
    calls = F.filter(F.coalesce("tool_calls", F.array().cast(turns.schema["tool_calls"].dataType)), lambda x: F.coalesce(F.size(x["file_paths"]), F.lit(0)) > 0)
    t = turns.withColumn("kept_calls", calls).withColumn("omitted_calls", F.greatest(F.lit(0), F.coalesce(F.size("tool_calls"), F.lit(0))) - F.size("kept_calls"))
    t = t.withColumn("prompt", strip("user_prompt")).withColumn("reply", strip("assistant_response"))
    return t.where(~(F.coalesce(F.col("prompt").rlike(PAUSE), F.lit(False)) & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)))

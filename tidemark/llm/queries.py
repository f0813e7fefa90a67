"""Queries of the training-data problems; each runs over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.runtime import cut, table, tokenizer_dir

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    return os.path.join(tokenizer_dir(), "byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pairs import find_defects

    return find_defects(table(spark, sf_dir, "filtered_turns"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import find_all

    return find_all(table(spark, sf_dir, "filtered_turns")).select("memory_id", "field", "pii_type", "pii_text").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import redact_all

    return redact_all(table(spark, sf_dir, "filtered_turns"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conversations import rebuild

    return rebuild(table(spark, sf_dir, "memories"), table(spark, sf_dir, "sessions"), table(spark, sf_dir, "filtered_turns"), f"{sf_dir}/memories.parque[t]")  # a pattern for just this name, which may be a file or a folder


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spans import texts_with_shared_spans

    return texts_with_shared_spans(table(spark, sf_dir, "filtered_turns"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spans import shared_shares

    return shared_shares(table(spark, sf_dir, "filtered_turns"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spans import clusters

    return clusters(table(spark, sf_dir, "filtered_turns"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbours import neighbour_pairs

    return neighbour_pairs(table(spark, sf_dir, "session_embeddings"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokenize import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), vocabulary())


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokenize import count_tokens

    return cut(count_tokens(table(spark, sf_dir, "documents"), vocabulary()), "p7-counted")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixture import draw

    return draw(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixture import draw, shares

    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(draw(counted, targets), counted, targets)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.subjects import assign, learn

    docs = table(spark, sf_dir, "documents")
    return assign(docs, learn(docs, table(spark, sf_dir, "doc_subjects"), table(spark, sf_dir, "subject_areas")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.subjects import composition

    return composition(_subjects(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p4_found": p4_found, "p4_shares": p4_shares, "p4_clusters": p4_clusters, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_composition": p8_composition}
#: SQL of all windows of 200 code points, and of those that another memory_id has too.
_WINDOWS = """t as (select distinct memory_id, field, text from (select memory_id, 'user_prompt' as field, user_prompt as text from filtered_turns union all select memory_id, 'assistant_response', assistant_response from filtered_turns)
  where memory_id is not null and length(text) >= 200),
l as (select memory_id, field, string_split(text, '') as c from t), w as (select memory_id, field, i, hash(array_to_string(c[i:i+199], '')) as h from (select memory_id, field, c, unnest(range(1, len(c) - 198)) as i from l)),
s as (select h, min(memory_id) as rep from w group by h having min(memory_id) <> max(memory_id))"""
_SHARES = """, p as (select distinct memory_id, field, i from w join s using (h)), g as (select memory_id, field, least(200, coalesce(lead(i) over (partition by memory_id, field order by i) - i, 200)) as n from p),
v as (select memory_id, field, cast(sum(n) as bigint) as n from g group by all),
z as (select memory_id, field, max(n_chars) as n_chars from (select memory_id, 'user_prompt' as field, length(user_prompt) as n_chars from filtered_turns union all select memory_id, 'assistant_response', length(assistant_response) from filtered_turns)
  where memory_id is not null and n_chars is not null group by all)
select z.memory_id, z.field, z.n_chars, least(z.n_chars, coalesce(v.n, 0)) as shared_chars, case when z.n_chars > 0 then least(z.n_chars, coalesce(v.n, 0)) / z.n_chars else 0.0 end as share
from z left join v on v.memory_id = z.memory_id and v.field = z.field"""
_CLUSTERS = """, q as (select distinct memory_id, field, rep from w join s using (h)), n as (select distinct memory_id as x, rep as y from q union select rep, memory_id from q),
r as (select x as id, x as via from n union select r.id, n.y from r join n on n.x = r.via), k as (select memory_id, count(distinct field) as texts from q group by 1)
select r.id as memory_id, min(via) as cluster, any_value(texts) as texts from r join k on k.memory_id = r.id group by r.id"""
#: SQL of the same results, where SQL can express the operator.
ORACLES: dict[str, str] = {"p3_found": r"""with s as (select distinct id, tool, native_id, segment_index from sessions where id is not null and tool is not null and native_id is not null),
segs as (select tool, native_id, min(coalesce(segment_index,-1))=0 and max(segment_index)+1=count(distinct segment_index) as whole from s group by all),
m as (select * from (select *, row_number() over (partition by session_id, turn_index order by reingested_at desc nulls last, id desc) rn from (select distinct id, session_id, turn_index, reingested_at from memories)) where rn=1),
t as (select memory_id, bool_or(coalesce(regexp_matches(user_prompt,'[\p{L}\p{N}]') and regexp_matches(assistant_response,'[\p{L}\p{N}]'),false)) ok from filtered_turns group by 1),
x as (select s.tool, s.native_id, s.segment_index, m.turn_index, m.id as memory_id, coalesce(t.ok,false) ok, segs.whole,
  row_number() over (partition by s.tool, s.native_id order by s.segment_index, m.turn_index)-1 as pos
  from m join s on m.session_id=s.id join segs on segs.tool=s.tool and segs.native_id=s.native_id left join t on t.memory_id=m.id),
good as (select tool, native_id from x group by all having bool_and(ok and whole and pos=turn_index))
select tool, native_id, cast(pos*2+sp.a as bigint) as msg_index, sp.speaker, memory_id
from x join good using (tool, native_id) cross join (select 0 as a, 'user' as speaker union all select 1, 'assistant') sp
""",
    "p4_found": f"with {_WINDOWS} select distinct memory_id, field from w join s using (h)",
    "p4_shares": f"with {_WINDOWS}{_SHARES}",
    "p4_clusters": f"with recursive {_WINDOWS}{_CLUSTERS}",
}

"""The core's queries over the store tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions import shell, titles
from tidemark.operators import assemble, dedupe, evidence, governance, ledger, projects, recall, rollups, segments, stats, store, transcripts, vectors
from tidemark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- parts of the SQL ------------------------------------------------------------------------------------------------

CTE = {
    "s": "s as (select * exclude (rn) from (select *, row_number() over (partition by id order by last_ingested_at desc nulls last) rn from sessions where id is not null) where rn = 1)",
    "m": "m as (select * exclude (rn) from (select *, row_number() over (partition by session_id, turn_index order by reingested_at desc nulls last, id desc) rn from memories where id is not null) where rn = 1)",
    "c": "c as (select * exclude (rn) from (select *, row_number() over (partition by memory_id order by filter_version desc nulls last, captured_at desc nulls last, user_prompt desc nulls last) rn from filtered_turns where memory_id is not null) where rn = 1)",
    "v": "v as (select session_id, model, model_revision, dimensions, vector from (select *, row_number() over (partition by session_id order by computed_at desc nulls last, model_revision desc nulls last, source_hash desc nulls last) rn from session_embeddings where session_id is not null) where rn = 1 and vector is not null and len(vector) = dimensions and list_bool_and(list_transform(vector, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(vector, lambda x: x <> 0)))",
}


def ctes(*names: str) -> str:
    return "with " + ",\n".join(CTE[n] for n in names)


def blank(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '^\s+|\s+$', '', 'g') = '', true)"


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def size(c: str) -> str:
    return f"greatest(0, coalesce(len({c}), 0))"


def folded(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({c}, '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'))"


def components(c: str) -> str:
    return rf"regexp_extract_all({folded(f"coalesce({c}, '')")}, '[\p{{L}}\p{{N}}]+')"


def lexical(c: str) -> str:
    """Compounds and components."""
    return rf"list_distinct(list_concat(regexp_extract_all({folded(f"coalesce({c}, '')")}, '[\p{{L}}\p{{N}}]+(?:[._/@:+-][\p{{L}}\p{{N}}]+)+'), {components(c)}))"


def uncontrolled(c: str) -> str:
    """Without terminal sequences and control characters."""
    return rf"regexp_replace(regexp_replace({c}, '\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b[@-_]?', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g')"


def utf8(c: str) -> str:
    return f"coalesce(strlen({c}), 0)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f
    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# --- statistics ------------------------------------------------------------------------------------------------------

@query(ctes("m") + " select tool, count(distinct session_id) as sessions, count(*) as memories from m group by tool")
def stats_by_tool(spark, d):
    return stats.by_tool(table(spark, d, "memories"))


@query(ctes("m") + """, n as (select count(*) as n from m where session_id is not null group by session_id)
select coalesce(min(n), 0) as least, coalesce(cast(median(n) as double), 0.0) as median, coalesce(max(n), 0) as most, count(*) as sessions from n""")
def stats_sessions(spark, d):
    return stats.per_session(table(spark, d, "memories"))


@query(ctes("m") + f" select session_id, cast(sum({size('pending_items')}) as bigint) as pending from m group by session_id")
def stats_pending(spark, d):
    return stats.pending_per_session(table(spark, d, "memories"))


@query(ctes("m") + f""" select project_id, path, count(*) as memories, cast(sum({size('pending_items')}) as bigint) as pending
from m join projects p on p.id = m.project_id group by project_id, path""")
def stats_by_project(spark, d):
    return stats.by_project(*_t(spark, d, "memories", "projects"))


@query(ctes("m") + f""" select tool, summarizer_status, count(*) as memories, count(*) filter ({size('decisions')} = 0 and {size('pending_items')} = 0) as noise,
count(*) filter ({size('files_touched')} = 0) as without_files from m group by all""")
def stats_noise(spark, d):
    return stats.noise(table(spark, d, "memories"))


@query("""select event_type, round(avg(case when value < 50 then 1.0 else 0.0 end), 6) as ok_ratio, avg(case when value < 50 then 1.0 else 0.0 end) >= 0.5 as healthy,
arg_max(event_id, (ts, event_id)) filter (not value < 50) as latest_failure from events group by event_type""")
def call_health(spark, d):
    return stats.health(table(spark, d, "events").withColumn("ok", F.col("value") < 50), "event_type", "ok", "ts", "event_id")


# --- served sessions -------------------------------------------------------------------------------------------------

# a rollup is there once all turns of a session are summed up; a session whose last activity is unknown has an open turn
SERVED = ctes("s", "m") + f""", per as (select session_id as id, count(*) as turns, sum({size('files_touched')}) as files, sum({size('decisions')}) as decisions, bool_and(coalesce(summarizer_status = 'ok', false)) as rolled from m group by 1),
served as (select s.id, s.tool, native_id, segment_index, project_id, coalesce(custom_title, title, 'untitled') as title, coalesce(surface, 'unknown') as surface,
coalesce(last_turn_at, last_ingested_at, started_at) as ended_at, cast(coalesce(turns, 0) as bigint) as turns, cast(coalesce(files, 0) as bigint) as files,
last_turn_at is null or case when coalesce(rolled, false) then coalesce(decisions, 0) > 0 else coalesce(turns, 0) >= 2 end or coalesce(files, 0) > 0 as substantive from s left join per using (id) where kind is distinct from 'adjudicator')"""


def _served(spark, d):
    s, m = _t(spark, d, "sessions", "memories")
    rolled = (store.current_memories(m).groupBy(F.col("session_id").alias("id")).agg(F.min(F.coalesce(F.col("summarizer_status") == "ok", F.lit(False))).alias("rolled"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("decisions"), F.lit(0)))).alias("notes"))
              .where("rolled"))
    return store.served_sessions(s, m, rolled, store.current_sessions(s).where("last_turn_at is null"))


@query(SERVED + " select * from served")
def served_sessions(spark, d):
    return _served(spark, d)


@query(SERVED + """, top as (select *, row_number() over (order by ended_at desc, id desc) as rank from served where substantive and tool = 'codex' and ended_at < timestamp '2025-11-01' order by rank limit 21)
select id, title, ended_at, cast(rank as int) as rank, (select count(*) from top) > 20 as has_more from top where rank <= 20""")
def list_page(spark, d):
    served = _served(spark, d)
    return store.page(served, F.lit("2025-11-01").cast("timestamp_ntz"), "codex").select("id", "title", "ended_at", "rank", "has_more")


@query(ctes("s") + """ select project_id, tool, surface, count(*) as sessions, max(last_ingested_at) as last_ingested_at,
arg_max(coalesce(last_turn_at, last_ingested_at, started_at), (coalesce(last_turn_at, last_ingested_at, started_at), id)) as newest_activity, arg_max(id, (coalesce(last_turn_at, last_ingested_at, started_at), id)) as newest_id
from s where kind is distinct from 'adjudicator' group by all""")
def project_activity(spark, d):
    return store.project_activity(table(spark, d, "sessions"))


@query(ctes("s") + """ select project_id, array_to_string(list_sort(list(distinct tool)), ',') as tools, array_to_string(list_sort(coalesce(list(distinct surface) filter (surface is not null), [])), ',') as surfaces,
max(coalesce(last_turn_at, last_ingested_at, started_at)) as newest, count(*) as sessions from s where kind is distinct from 'adjudicator' group by project_id""")
def list_projects(spark, d):
    s = store.current_sessions(table(spark, d, "sessions")).where(store.served_kind())
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return s.groupBy("project_id").agg(text("tool").alias("tools"), text("surface").alias("surfaces"), F.max(store.ended_at()).alias("newest"), F.count("*").alias("sessions"))


@query(ctes("s") + """ select tool, native_id, arg_max(segment_index, (segment_index, id)) as segment_index, arg_max(id, (segment_index, id)) as session_id, count(*) as segments,
min(segment_index) = 0 and max(segment_index) + 1 = count(distinct segment_index) as whole from s group by tool, native_id""")
def latest_segments(spark, d):
    return store.latest_segments(table(spark, d, "sessions"))


@query(ctes("s", "m") + """ select m.id, lag(m.id) over w as previous_id, round(coalesce(greatest(0.0, (epoch_us(turn_started_at) - epoch_us(lag(turn_started_at) over w)) / 3.6e9), 0.0), 6) as gap_hours
from m join s on s.id = m.session_id window w as (partition by s.tool, native_id order by segment_index, turn_index, m.id)""")
def predecessors(spark, d):
    return store.predecessors(*_t(spark, d, "memories", "sessions"))


@query(ctes("s", "m") + """ select m.id, count(*) over w as turns_so_far, max(segment_index) over w as segment_index
from m join s on s.id = m.session_id window w as (partition by s.tool, native_id order by segment_index, turn_index, m.id rows unbounded preceding)""")
def chat_before(spark, d):
    return store.chat_before(*_t(spark, d, "memories", "sessions"))


STATES = ctes("m", "c") + """, st as (select m.id, session_id, case when c.memory_id is null then 'missing' when filter_version is distinct from 3 then 'outdated' when reingested_at is not null and coalesce(captured_at < reingested_at, true) then 'superseded' else 'current' end as state,
case when not coalesce(included, false) then 'excluded' when coalesce(omitted_before_chars, 0) > 0 then 'truncated' else 'included' end as coverage from m left join c on c.memory_id = m.id)"""
# sessions of the adjudicator stand for those whose parsing failed, sessions without rendered text for those evicted
CAPTURES = STATES + """, cs as (select session_id, count(*) as turns, count(*) filter (state <> 'current') as gaps, count(*) filter (state <> 'missing') as held, case when session_id in (select id from sessions where kind = 'adjudicator') then 'parse_error'
when count(*) filter (state <> 'current') > 0 then 'disabled_gap' when count(*) filter (coverage = 'truncated') > 0 then 'complete_truncated' else 'complete' end as state from st group by session_id)"""
COVERAGE = CAPTURES + """, cov as (select session_id, turns, case when session_id in (select id from sessions where rendered_chars is null) then 'evicted' when state in ('complete', 'complete_truncated') and gaps = 0 then state when held > 0 then 'incomplete' else 'never' end as bucket from cs)"""


def _captures(spark, d):
    s, m, t = _t(spark, d, "sessions", "memories", "filtered_turns")
    return store.capture_states(store.copy_state(m, t, version=3), s.where("kind = 'adjudicator'").select(F.col("id").alias("session_id")))


def _coverage(spark, d):
    return store.session_coverage(_captures(spark, d), table(spark, d, "sessions").where("rendered_chars is null").select(F.col("id").alias("session_id")))


@query(STATES + " select * from st")
def copy_state(spark, d):
    return store.copy_state(*_t(spark, d, "memories", "filtered_turns"), version=3)


@query(CAPTURES + " select * from cs where session_id is not null")
def capture_states(spark, d):
    return _captures(spark, d).where("session_id is not null")


@query(COVERAGE + " select * from cov where session_id is not null")
def session_coverage(spark, d):
    return _coverage(spark, d).where("session_id is not null")


# what begins with this word stands for a command
COMMAND = "fix"
CANDIDATES = f"""cand as (select *, coalesce(last_turn_at, last_ingested_at, started_at) as ended_at from s where kind is distinct from 'adjudicator' and not (
not (not {blank('custom_title')} or (not {blank('title')} and {trimmed('title')} <> 'untitled')) and (coalesce(starts_with(lower(ltrim(custom_title)), '{COMMAND}'), false) or coalesce(starts_with(lower(ltrim(title)), '{COMMAND}'), false) or coalesce(starts_with(lower(ltrim(first_prompt_search)), '{COMMAND}'), false))))"""


@query(ctes("s") + f", {CANDIDATES} select id, ended_at from cand")
def recall_candidates(spark, d):
    return store.recall_candidates(table(spark, d, "sessions"), COMMAND).select("id", "ended_at")


@query(COVERAGE + f""", {CTE['s']}, {CANDIDATES}, seen as (select id from cand order by ended_at desc nulls last, id limit 5000),
x as (select cand.*, seen.id is not null as seen, coalesce(bucket, 'never') as bucket from cand left join seen on seen.id = cand.id left join cov on cov.session_id = cand.id),
per as (select project_id, count(*) as n, count(*) filter (seen and first_prompt_search is not null) as k from x group by project_id)
select (select count(*) from per) as projects, (select count(*) from per where n = k) as projects_searched, count(*) as sessions, count(*) filter (seen and first_prompt_search is not null) as sessions_searched, {', '.join(f"count(*) filter (bucket = '{b}') as {b}" for b in store.BUCKETS)},
count(*) filter (seen and first_prompt_search is null) as unindexed, count(*) = count(*) filter (seen and first_prompt_search is not null) and count(*) = count(*) filter (bucket = 'complete') as conclusive from x""")
def recall_coverage(spark, d):
    s = table(spark, d, "sessions")
    # the newest 5,000 sessions are searched, and what is left out is said
    return store.recall_coverage(store.recall_candidates(s, COMMAND), store.recall_candidates(s, COMMAND, newest=5000), _coverage(spark, d))


@query("select distinct memory_id from filtered_turns where memory_id is not null and memory_id not in (select id from memories where id is not null)")
def orphan_copies(spark, d):
    m, t = _t(spark, d, "memories", "filtered_turns")
    return t.where("memory_id is not null").select("memory_id").distinct().join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


@query(ctes("m", "c") + rf""", f as (select session_id, arg_min((turn_index, user_prompt), (turn_index, m.id)) as x from m join c on c.memory_id = m.id where not {blank('user_prompt')} group by session_id)
select session_id, x[1] as turn_index, left(regexp_replace(x[2], '\$\(|`|\$\{{|&&|\|\||;;', ' ', 'g'), 4000) as document from f""".replace("x[1]", "struct_extract_at(x, 1)").replace("x[2]", "struct_extract_at(x, 2)"))
def first_prompts(spark, d):
    return store.first_prompts(*_t(spark, d, "memories", "filtered_turns"))


@query("select * from (select l_orderkey, l_linenumber, l_shipdate from lineitem where (l_orderkey, l_linenumber) > (10000, 2) order by l_orderkey, l_linenumber limit 51)")
def keyset_page(spark, d):
    return store.keyset_page(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey", "l_linenumber"], [10000, 2], 50)


@query("""with t as (select c_custkey as k, c_name as name, c_acctbal as v from customer), n as (select s_suppkey as k, s_name as name, s_acctbal as v from supplier)
select * from t where k not in (select k from n) union all select * from n""")
def upsert(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return store.upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v")), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v")), ["k"])


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 5")
def last_per_user(spark, d):
    return store.newest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "ts")


@query("select o_custkey, min(o_orderkey) as first, max(o_totalprice) as most from orders group by o_custkey having min(o_orderkey) > 100 and max(o_totalprice) < 200000")
def having_sweep(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_totalprice").alias("most")).where("first > 100 and most < 200000")


# --- records and segments --------------------------------------------------------------------------------------------

RECORDS = ctes("m", "c") + """, r as (select session_id as file, turn_index * 2 as pos, 'boundary' as kind, 'user' as role, turn_started_at as ts, user_prompt as text from m join c on c.memory_id = m.id where session_id is not null
union all select session_id, turn_index * 2 + 1, 'content', 'assistant', turn_started_at, assistant_response from m join c on c.memory_id = m.id where session_id is not null)"""


def _records(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    j = store.current_memories(m).where("session_id is not null").join(store.current_copies(c).withColumnRenamed("memory_id", "id"), "id")
    side = lambda at, kind, role, text: F.struct((F.col("turn_index") * 2 + at).alias("pos"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.col("turn_started_at").alias("ts"), F.col(text).alias("text"))
    return j.select(F.col("session_id").alias("file"), F.inline(F.array(side(0, "boundary", "user", "user_prompt"), side(1, "content", "assistant", "assistant_response"))))


@query(RECORDS + rf""", g as (select *, sum(case when kind = 'boundary' then 1 else 0 end) over (partition by file order by pos) as grp from r),
t as (select file, grp, min(pos) as first_pos, min(ts) as started_at, coalesce(string_agg({trimmed('text')}, chr(10) order by pos) filter (role = 'user' and not {blank('text')}), '') as user_text,
coalesce(string_agg({trimmed('text')}, chr(10) order by pos) filter (role = 'assistant' and not {blank('text')}), '') as assistant_text from g where grp > 0 group by file, grp)
select file, first_pos, started_at, user_text, assistant_text, cast(row_number() over (partition by file order by grp) - 1 as int) as turn_index from t where user_text <> '' or assistant_text <> ''""")
def turn_assembly(spark, d):
    return assemble.assemble(_records(spark, d)).select("file", "first_pos", "started_at", "user_text", "assistant_text", "turn_index")


@query("""select event_id, last_value(case when value > 10 then event_type end ignore nulls) over w as kind, last_value(case when event_type = 'click' then value end ignore nulls) over w as clicked
from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def context_carry(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 10, F.col("event_type")).alias("kind"), F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"))
    return assemble.carried(e, "user_id", ["ts", "event_id"], ["kind", "clicked"]).select("event_id", "kind", "clicked")


@query("""select event_type as file, count(*) as records, count(*) filter (not json_valid(props)) as malformed, count(*) filter (json_valid(props) and coalesce(json_extract_string(props, '$.type'), '') not in ('user', 'assistant')) as unrecognized from events group by 1""")
def record_accounting(spark, d):
    return assemble.accounting(table(spark, d, "events").withColumnRenamed("event_type", "file"), "props", ["user", "assistant"])


@query(ctes("c") + rf""", x as (select memory_id, user_prompt, assistant_response, tool_calls, list_filter(coalesce(tool_calls, []), lambda x: len(x.file_paths) > 0) as kept from c)
select memory_id, len(kept) as kept_calls, {size('tool_calls')} - len(kept) as omitted_calls, {trimmed('user_prompt')} as prompt, {trimmed('assistant_response')} as reply
from x where not (coalesce(regexp_matches({trimmed('user_prompt')}, '(?i)\b(?:no\s+(?:hagas?|hacer|toques?)\s+nada(?:\s+de\s+momento)?|do(?:n''t| not)\s+(?:do|change|touch)\s+anything|hold\s+off|pause\s+here|wait\s+for\s+now)\b'), false) and {size('tool_calls')} = 0)""")
def turn_projection(spark, d):
    p = assemble.projection(store.current_copies(table(spark, d, "filtered_turns")))
    return p.select("memory_id", F.size("kept_calls").cast("bigint").alias("kept_calls"), F.col("omitted_calls").cast("bigint").alias("omitted_calls"), "prompt", "reply")


@query("""with g as (select *, coalesce(greatest(0.0, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 3.6e9), 0.0) as gap, row_number() over w as n, lag(event_type) over w as was from events window w as (partition by user_id order by ts, event_id))
select event_id, cast(sum(case when n > 1 and (gap >= 168 or (gap >= 4 and event_type <> was)) then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as segment from g""")
def segments_by_branch(spark, d):
    return segments.by_gap_and_branch(table(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], "event_type").select("event_id", F.col("segment").cast("bigint").alias("segment"))


@query()
def segments_full(spark, d):
    e = table(spark, d, "events").withColumn("files", F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))))
    return segments.with_state(e, "user_id", "ts", ["ts", "event_id"], "event_type", "files").select("event_id", "segment")


@query(ctes("m") + """ select id, round(case when len(files_touched) > 0 and len(p) > 0 then len(list_distinct(list_intersect(p, files_touched))) / len(list_distinct(list_concat(p, files_touched))) end, 6) as overlap
from (select *, lag(files_touched) over (partition by session_id order by turn_index, id) as p from m)""")
def file_overlap(spark, d):
    m = store.current_memories(table(spark, d, "memories"))
    return dedupe.overlap_along(m, ["session_id"], ["turn_index", "id"], "files_touched").select("id", "overlap")


# --- ledger ----------------------------------------------------------------------------------------------------------

def _list_bytes(c: str) -> str:
    return f"coalesce(list_sum(list_transform({c}, lambda x: {utf8('x')})), 0)"


CHARGES = ctes("s") + f""", o as (select id as memory_id, min(session_id) as session_id from memories where id is not null group by 1),
ch as (select 'sessions' as part, id as session_id, cast({utf8('title')} + {utf8('custom_title')} + {utf8('first_prompt_search')} + {_list_bytes('trailing_files')} as bigint) as bytes from s
union all select 'memories', session_id, cast(coalesce(list_sum(list_transform(decisions, lambda x: {utf8('x.what')} + {utf8('x.why')})), 0) + {_list_bytes('files_touched')} + {_list_bytes('pending_items')} as bigint) from memories
union all select 'copies', o.session_id, cast(2 * ({utf8('user_prompt')} + {utf8('assistant_response')}) as bigint) from filtered_turns t left join o on o.memory_id = t.memory_id
union all select 'vectors', session_id, cast(4 * {size('vector')} as bigint) from session_embeddings)"""


def _charges(spark, d):
    return ledger.charges(*_t(spark, d, "sessions", "memories", "filtered_turns", "session_embeddings"))


@query(CHARGES + " select part, count(*) as rows, cast(sum(bytes) as bigint) as bytes from ch group by part")
def ledger_totals(spark, d):
    return ledger.totals(_charges(spark, d))


BY_CHAT = CHARGES + ", u as (select tool, native_id, count(*) as rows, cast(sum(bytes) as bigint) as bytes, min(started_at) as started_at from ch join s on s.id = ch.session_id group by tool, native_id)"


@query(BY_CHAT + " select * from u")
def ledger_by_chat(spark, d):
    return ledger.by_chat(_charges(spark, d), table(spark, d, "sessions"))


@query(BY_CHAT + """ select tool, native_id, bytes, cast(b as bigint) as before from (select *, coalesce(sum(bytes) over (order by started_at is null, started_at, tool, native_id rows between unbounded preceding and 1 preceding), 0) as b from u) where b < 1000000""")
def retention_prefix(spark, d):
    return ledger.oldest_first(ledger.by_chat(_charges(spark, d), table(spark, d, "sessions")), 1_000_000)


# --- projects --------------------------------------------------------------------------------------------------------

def _known(c: str) -> str:
    return f"nullif(trim(coalesce({c}, '')), '')"


IDENTITY = f"coalesce('remote:' || {_known('git_remote')}, 'commit:' || {_known('git_root_commit')}, 'root:' || {_known('git_root')})"
GROUPS = f"""with k as (select id, path, {IDENTITY} as key from projects),
g as (select id, key as group_key from k where key is not null union all
select a.id, 'path:' || coalesce(arg_min(b.path, len(b.path)), any_value(a.path)) from k a left join k b on b.key is null and (a.path = b.path or starts_with(a.path, b.path || '/')) where a.key is null and a.path is not null group by a.id)"""


@query(GROUPS + " select * from g")
def project_groups(spark, d):
    return projects.groups(table(spark, d, "projects"))


@query(GROUPS + """ select group_key, arg_min(id, (len(list_filter(string_split(path, '/'), lambda x: x <> '')), path, id)) as id, count(*) as rows from g join projects using (id) group by group_key""")
def canonical_projects(spark, d):
    return projects.canonical(table(spark, d, "projects"))


# every project's root decides for what lies under it: with a remote it is approved, without one denied, and without a name it is pending
ROOTS = f"""r as (select path as root, case when display_name is null then 'pending' when {_known('git_remote')} is null then 'denied' else 'approved' end as state, case when git_root is null then 'cli' else 'scan' end as source, first_seen_at as decided_at, id as ulid from projects where path is not null),
b as (select root, state from (select *, row_number() over (partition by root order by source = 'cli' desc, decided_at desc, ulid desc) rn from r where state <> 'pending') where rn = 1)"""


def _roots(p: DataFrame) -> DataFrame:
    return p.where("path is not null").select(F.col("path").alias("root"), F.when(F.col("display_name").isNull(), "pending").when(projects._set("git_remote").isNull(), "denied").otherwise("approved").alias("state"), F.when(F.col("git_root").isNull(), "cli").otherwise("scan").alias("source"), F.col("first_seen_at").alias("decided_at"), F.col("id").alias("ulid"))


@query(f"""with {ROOTS}, p as (select distinct path from (select path from projects where path is not null union all select source_path from sessions where source_path is not null))
select p.path, coalesce(arg_max(state, len(root)), 'pending') as state from p left join b on p.path = b.root or starts_with(p.path, b.root || '/') group by p.path""")
def consent_states(spark, d):
    p, s = _t(spark, d, "projects", "sessions")
    paths = p.where("path is not null").select("path").unionByName(s.where("source_path is not null").select(F.col("source_path").alias("path")))
    return projects.consent(paths, _roots(p))


@query(GROUPS + f""", {ROOTS}, st as (select p.id, arg_max(state, len(root)) as state from projects p join b on p.path = b.root or starts_with(p.path, b.root || '/') group by p.id)
select g.id from g join st using (id) where state = 'approved' and group_key not in (select group_key from g join st using (id) where state = 'denied')""")
def consented_projects(spark, d):
    p = table(spark, d, "projects")
    g = projects.groups(p).join(p.select("id", "path"), "id").join(projects.consent(p.where("path is not null"), _roots(p)), "path")
    vetoed = g.where("state = 'denied'").select("group_key").distinct()
    return g.where("state = 'approved'").join(vetoed, "group_key", "left_anti").select("id")


@query(f"""with recursive keys as (select id, unnest(list_filter(['remote:' || {_known('git_remote')}, 'commit:' || {_known('git_root_commit')}, 'root:' || {_known('git_root')}, 'path:' || path], lambda x: x is not null)) as key from projects),
e as (select distinct a.id as a, b.id as b from keys a join keys b using (key)), w as (select a as id, a as via from e union select w.id, e.b from w join e on e.a = w.via)
select id, min(via) as component from w group by id""")
def identity_components(spark, d):
    return projects.components(projects.identity_keys(table(spark, d, "projects")), "id", "key")


@query("""with q as (select distinct display_name as query from projects where display_name is not null), x as (select query, id, case when path = query then 1 when git_root = query then 2 when git_remote = query then 3
when lower(display_name) = lower(query) or lower(string_split(path, '/')[-1]) = lower(query) then 4 when contains(lower(path), lower(query)) then 5 end as rank from projects, q)
select query, cast(rank as int) as rank, id from (select *, min(rank) over (partition by query) as best from x where rank is not null) where rank = best""")
def resolve_projects(spark, d):
    p = table(spark, d, "projects")
    return projects.resolve(p, p.where("display_name is not null").select(F.col("display_name").alias("query")))


# --- retrieval -------------------------------------------------------------------------------------------------------

@query(ctes("v") + """, n as (select *, sqrt(list_dot_product(cast(vector as double[]), cast(vector as double[]))) as norm from v)
select query_id, session_id, similarity, cast(rank as int) as rank from (select q.session_id as query_id, n.session_id, round(greatest(-1.0, least(1.0, list_dot_product(cast(q.vector as double[]), cast(n.vector as double[])) / (q.norm * n.norm))), 6) as similarity,
row_number() over (partition by q.session_id order by similarity desc, n.session_id desc) as rank from n q join n on n.model is not distinct from q.model and n.model_revision is not distinct from q.model_revision and n.dimensions = q.dimensions and n.session_id <> q.session_id where q.session_id % 50 = 0) where rank <= 5""")
def semantic_top5(spark, d):
    v = vectors.fresh(table(spark, d, "session_embeddings"))
    return vectors.top_k(v, v.where(F.col("session_id") % 50 == 0), 5)


QUESTION = "Why does the flush interval lease fail in the roster worker?"


_TOKENS = recall.query_tokens(QUESTION)
_Q = recall.question(QUESTION)
_HELD = f"list_filter({list(_Q.tokens)!r}, lambda w: list_contains({{}}, w))"
NOTES = ctes("m") + rf""", dd as (select session_id, turn_index, id, p, d, lower({trimmed(uncontrolled('d.what'))}) as key from (select session_id, turn_index, id, generate_subscripts(decisions, 1) as p, unnest(decisions) as d from m) where not {blank('d.what')}),
notes as (select session_id, key, struct_extract(arg_min(struct_pack(x := d.what), (turn_index, id, p)), 'x') as what, struct_extract(arg_min(struct_pack(x := case when not {blank('d.why')} then d.why end), (turn_index, id, p)), 'x') as why, min(turn_index) as turn_index, count(*) as times from dd group by session_id, key)"""
BEST = f"""bt as (select session_id as id, {components("concat_ws(chr(10), user_prompt, assistant_response)")} as t from m join c on c.memory_id = m.id), bn as (select *, len(t) as length from bt where len(t) > 0), bz as (select count(*) as n, avg(length) as mean from bn),
bp as (select id, length, token, len(list_filter(t, lambda x: x = token)) as tf from bn, (select unnest({_TOKENS!r}) as token)), bd as (select token, count(*) as df from bp where tf > 0 group by token),
best as (select id, round(max(greatest(1e-6, ln((bz.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as bm25 from bp join bd using (token), bz where tf > 0 group by id)"""


def _contents(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    return (store.current_memories(m).select("id", "session_id").join(store.current_copies(c).select(F.col("memory_id").alias("id"), titles.nfkc(F.concat_ws("\n", "user_prompt", "assistant_response")).alias("text")), "id")
            .select(F.col("session_id").alias("id"), "text"))


@query(ctes("m", "c") + f", {BEST} select * from best where id is not null")
def bm25_by_session(spark, d):
    return recall.bm25_by_session(_contents(spark, d), QUESTION).where("id is not null")


@query(NOTES + f""", {CTE['s']}, {CTE['c']}, {CANDIDATES}, {BEST}, pend as (select session_id as id, arg_max(coalesce(pending_items, []), (turn_index, id)) as p from m group by 1), ru as (select session_id as id, string_agg(concat_ws(' ', what, why), ' ') as r from notes group by 1),
sv as (select id, ended_at, {lexical("concat_ws(' ', custom_title, title)")} as ct, {lexical('first_prompt_search')} as cp, {lexical("concat_ws(' ', r, array_to_string(p, ' '))")} as cr, {components('first_prompt_search')} as pw from cand left join ru using (id) left join pend using (id)),
tx as (select session_id as id, {lexical("concat_ws(chr(10), user_prompt, assistant_response)")} as t from m join c on c.memory_id = m.id), it as (select id, list_distinct(flatten(list({_HELD.format('t')}))) as it from tx group by id),
h as (select id, ended_at, {_HELD.format('ct')} as a, {_HELD.format('cp')} as b, {_HELD.format('cr')} as r, coalesce(it, []) as it, contains(array_to_string(pw, ' '), '{_Q.phrase}') as ph from sv left join it using (id)),
u as (select *, list_distinct(list_concat(list_concat(list_concat(a, b), r), it)) as hit from h), n as (select count(*) as n from u), k as (select token, count(*) filter (list_contains(hit, token)) as df from u, (select unnest({list(_Q.tokens)!r}) as token) group by token),
w as (select token, ln((n + 1) / (df + 1)) + 1 as wt from k, n), sc as (select id, ended_at, round(sum(wt), 6) as score, any_value(case when len(a) > 0 then 12000 when ph then 10000 when len(r) > 0 then 6000 when len(it) > 0 then 4500 else 3000 end) as tier, count(*) as hits, count(*) filter (token in {tuple(_TOKENS)!r}) as comps from u join w on list_contains(hit, token) group by id, ended_at),
f as (select * from sc where comps > 0 and score >= (select round(max(wt), 6) from w)), g as (select f.*, case when tier = 4500 then coalesce(bm25, 0) else 0 end as cb from f left join best using (id) where comps = {len(_TOKENS)} or not exists (select 1 from f where comps = {len(_TOKENS)})),
top as (select *, row_number() over (order by score desc, tier desc, cb desc, ended_at desc nulls last, id) as r from g)
select id, score, tier, cast(hits as int) as hits from top where hits >= 2 or (select hits from top where r = 1) < 2 order by r limit 5""")
def recall_sessions(spark, d):
    return recall_for(spark, d, QUESTION)


def recall_for(spark, d, text):
    """The best sessions for a question."""
    s, m = _t(spark, d, "sessions", "memories")
    m = store.current_memories(m)
    note = rollups.merged_decisions(m).groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "what", "why")), " ").alias("r"))
    open_ = m.groupBy(F.col("session_id").alias("id")).agg(F.max_by(F.coalesce("pending_items", F.array().cast("array<string>")), F.struct("turn_index", "id")).alias("p"))
    served = (store.recall_candidates(s, COMMAND).join(note, "id", "left").join(open_, "id", "left")
              .select("id", titles.nfkc(F.concat_ws(" ", "custom_title", "title")).alias("title"), titles.nfkc(F.col("first_prompt_search")).alias("prompt"), titles.nfkc(F.concat_ws(" ", "r", F.array_join("p", " "))).alias("rollup"), "ended_at"))
    return recall.recall(served, _contents(spark, d), text)


@query(ctes("c") + f""", t as (select memory_id as doc, {components("concat_ws(' ', user_prompt, assistant_response)")} as t from c), n as (select doc, t, len(t) as length from t where len(t) > 0),
q as (select unnest({_TOKENS!r}) as token), p as (select doc, length, token, len(list_filter(t, lambda x: x = token)) as tf from n, q), df as (select token, count(*) as df from p where tf > 0 group by token), z as (select count(*) as n, avg(length) as mean from n)
select doc, round(sum(greatest(1e-6, ln((z.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from p join df using (token), z where tf > 0 group by doc order by score desc, doc limit 20""")
def bm25_turns(spark, d):
    c = store.current_copies(table(spark, d, "filtered_turns"))
    return recall.bm25(c, "memory_id", F.concat_ws(" ", "user_prompt", "assistant_response"), QUESTION)


@query(ctes("c") + f""", t as (select {components('user_prompt')} as t from c) select token, count(*) as documents, cast(sum(n) as bigint) as occurrences from (select token, count(*) as n from (select row_number() over () as i, t from t), unnest(t) as u(token) group by i, token) group by token""")
def prompt_vocabulary(spark, d):
    c = store.current_copies(table(spark, d, "filtered_turns"))
    return recall.postings(c, "memory_id", "user_prompt").groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").cast("bigint").alias("occurrences"))


@query(ctes("s") + """, a as (select id, row_number() over (order by rendered_chars desc, id) as r from s where rendered_chars is not null), b as (select id, row_number() over (order by started_at desc, id) as r from s),
x as (select id, min((case when src = 0 then 0 else 1 end, r)) as k from (select id, 0 as src, r from a where r <= 50 union all select id, 1, r from b where r <= 80) group by id) select id, cast(row_number() over (order by k, id) as int) as position from x""")
def hybrid_union(spark, d):
    from pyspark.sql import Window

    s = store.current_sessions(table(spark, d, "sessions"))
    top = lambda df, order, n: df.orderBy(*order).limit(n).withColumn("r", F.row_number().over(Window.orderBy(*order))).select("id", "r")
    return vectors.ordered_union(top(s.where("rendered_chars is not null"), [F.desc("rendered_chars"), F.asc("id")], 50), top(s, [F.desc("started_at"), F.asc("id")], 80), "id", "r")


# --- duplicates ------------------------------------------------------------------------------------------------------

def _normal(c: str) -> str:
    return rf"lower({trimmed(rf"regexp_replace({c}, '\s+', ' ', 'g')")})"


@query(ctes("c") + f" select digest, count(distinct memory_id) as copies, min(memory_id) as first from (select memory_id, sha256({_normal('assistant_response')}) as digest from c where not {blank('assistant_response')}) group by digest having count(distinct memory_id) > 1")
def duplicate_replies(spark, d):
    return dedupe.duplicates(store.current_copies(table(spark, d, "filtered_turns")), "memory_id", "assistant_response")


@query(ctes("s", "m", "c") + rf""", x as (select m.id, {_normal('c.user_prompt')} as t, {_normal('s.first_prompt_search')} as b, list_filter(list_transform(regexp_split_to_array(s.first_prompt_search, '\r?\n'), lambda y: {_normal('y')}), lambda y: length(y) >= 40) as lines
from m join c on c.memory_id = m.id join s on s.id = m.session_id), z as (select *, list_distinct(list_transform(range(1, greatest(1, length(b) - 7) + 1), lambda i: substr(b, i, 8))) as sh from x)
select id, coalesce(len(list_filter(lines, lambda y: contains(t, y))) > 0 or (length(b) >= 8 and len(list_filter(sh, lambda y: contains(t, y))) >= ceil(len(sh) * 0.6)), false) as near from z""")
def near_verbatim(spark, d):
    s, m, c = _t(spark, d, "sessions", "memories", "filtered_turns")
    j = (store.current_memories(m).select("id", "session_id").join(store.current_copies(c).select(F.col("memory_id").alias("id"), "user_prompt"), "id")
         .join(store.current_sessions(s).select(F.col("id").alias("session_id"), "first_prompt_search"), "session_id"))
    return j.select("id", dedupe.near_verbatim(F.col("user_prompt"), F.col("first_prompt_search")).alias("near"))


def _fields(calls: str, prefix: str = "m.") -> str:
    return f"[{prefix}tool, cast({prefix}project_id as varchar), cast(epoch_us({prefix}turn_started_at) as varchar), user_prompt, assistant_response, {calls}, case when included then null else 'dropped' end, case when coalesce({prefix}has_external_content, false) then 'external' else 'own' end]"


def _digest(calls: str) -> str:
    return f"sha256(array_to_string(list_transform({_fields(calls)}, lambda x: coalesce(length(x) || ':' || x, '-')), '|'))"


_CALLS = "array_to_string(list_transform(tool_calls, lambda x: coalesce(x.name, '') || '(' || coalesce(array_to_string(x.file_paths, ','), '') || ')'), ';')"


@query(ctes("m", "c") + f""", o as (select session_id, turn_index, was from (select m.session_id, turn_index, {_digest(_CALLS)} as was, row_number() over (partition by m.session_id, turn_index order by reingested_at nulls first, m.id) rn from memories m join c on c.memory_id = m.id where m.id is not null and m.session_id is not null) where rn = 1),
n as (select session_id, turn_index, {_digest(_CALLS)} as now from m join c on c.memory_id = m.id where session_id is not null), ch as (select session_id, min(turn_index) as first_changed from o left join n using (session_id, turn_index) where was is distinct from now group by 1)
select o.session_id, count(*) as kept, max(first_changed) as first_changed from o left join ch using (session_id) where first_changed is null or turn_index < first_changed group by 1""")
def reconcile(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    c = store.current_copies(c).withColumnRenamed("memory_id", "id").select("id", "user_prompt", "assistant_response", "tool_calls", "included")
    calls = F.array_join(F.transform("tool_calls", lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit("("), F.coalesce(F.array_join(x["file_paths"], ","), F.lit("")), F.lit(")"))), ";")
    parts = [F.col("tool"), F.col("project_id").cast("string"), F.unix_micros(F.col("turn_started_at").cast("timestamp")).cast("string"), F.col("user_prompt"), F.col("assistant_response"), calls,
             F.when(F.coalesce("included", F.lit(False)), None).otherwise("dropped"), F.when(F.coalesce("has_external_content", F.lit(False)), "external").otherwise("own")]
    of = lambda rows: rows.where("session_id is not null").join(c, "id").select("id", "session_id", "turn_index", "reingested_at", dedupe.digest(*parts).alias("digest"))
    old = store.first_by(of(m.where("id is not null").select("id", "session_id", "turn_index", "reingested_at", "tool", "project_id", "turn_started_at", "has_external_content")), ["session_id", "turn_index"], [F.asc_nulls_first("reingested_at"), F.asc("id")])
    changes = dedupe.first_changes(old, of(store.current_memories(m)), "session_id", "turn_index", "digest")
    kept = dedupe.retract(old, changes, "session_id", "turn_index").groupBy("session_id").agg(F.count("*").alias("kept"))
    return kept.join(changes, "session_id", "left").select("session_id", "kept", "first_changed")


# --- rollups ---------------------------------------------------------------------------------------------------------

@query(NOTES + " select session_id, key, what, why, turn_index, times from notes")
def merged_decisions(spark, d):
    return rollups.merged_decisions(store.current_memories(table(spark, d, "memories")))


@query(NOTES + f""", b as (select session_id, count(*) as turns, max(turn_index) as through, arg_max({size('pending_items')}, (turn_index, id)) as pending from m group by session_id),
f as (select session_id, count(distinct x) as files from m, unnest(files_touched) as u(x) group by session_id), k as (select session_id, count(*) as decisions from notes group by session_id)
select b.session_id, turns, through, coalesce(decisions, 0) as decisions, coalesce(files, 0) as files, cast(pending as bigint) as pending from b left join k on k.session_id is not distinct from b.session_id and b.session_id is not null left join f on f.session_id = b.session_id where b.session_id is not null""")
def session_rollups(spark, d):
    return rollups.rollup(store.current_memories(table(spark, d, "memories")).where("session_id is not null"))


@query(ctes("m", "c").replace("with ", "with recursive ", 1) + """, r as (select session_id, id, n, row_number() over (partition by session_id order by turn_index, id) as k from (select m.session_id, m.id, turn_index, coalesce(length(assistant_response), 0) as n from m join c on c.memory_id = m.id)),
w as (select session_id, id, k, 0 as batch, n as total from r where k = 1 union all select r.session_id, r.id, r.k, case when w.total > 0 and w.total + r.n > 2000 then w.batch + 1 else w.batch end, case when w.total > 0 and w.total + r.n > 2000 then r.n else w.total + r.n end from w join r on r.session_id is not distinct from w.session_id and r.k = w.k + 1)
select id, cast(batch as int) as batch from w""")
def packed_batches(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    j = store.current_memories(m).select("id", "session_id", "turn_index").join(store.current_copies(c).select(F.col("memory_id").alias("id"), F.coalesce(F.length("assistant_response"), F.lit(0)).alias("n")), "id")
    return rollups.pack(j, "session_id", ["turn_index", "id"], "n", 2000).select("id", "batch")


@query(ctes("m", "c") + """ select id from (select m.id, sum(coalesce(length(user_prompt), 0) + coalesce(length(assistant_response), 0) + 1) over (partition by session_id order by turn_index desc, m.id desc rows unbounded preceding) - 1 as n from m join c on c.memory_id = m.id) where n <= 4000""")
def budget_tail(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    j = store.current_memories(m).select("id", "session_id", "turn_index").join(store.current_copies(c).withColumnRenamed("memory_id", "id"), "id")
    n = F.coalesce(F.length("user_prompt"), F.lit(0)) + F.coalesce(F.length("assistant_response"), F.lit(0))
    return rollups.newest_within(j, "session_id", [F.desc("turn_index"), F.desc("id")], n, 4000).select("id")


def _telling(c: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_./-]+', ' ', 'g'), ' '), lambda w: length(w) > 2 and not list_contains({list(rollups.STOP_WORDS)!r}, w)))"


# the turn that a note claims is the next one, so that claims fail at the end of each session
@query(NOTES + f""", t as (select session_id, turn_index as t, {_telling("array_to_string(list_transform(decisions, lambda x: coalesce(x.what, '')), ' ')")} as words from m where session_id is not null),
o as (select session_id, key, turn_index + 1 as claimed, {_telling('what')} as own from notes where session_id is not null and length(key) % 3 = 0 union all select session_id, key, null, {_telling('what')} from notes where session_id is not null and length(key) % 3 <> 0),
x as (select o.session_id, key, claimed, t, case when len(own) > 0 and len(words) > 0 then len(list_intersect(own, words)) / least(len(own), len(words)) else 0.0 end as s from o join t on t.session_id = o.session_id)
select session_id, key, case when bool_or(t = claimed) then any_value(claimed) else coalesce(arg_min(t, (-s, t)) filter (s >= 0.5), max(t)) end as turn_index, case when bool_or(t = claimed) then 'claimed' when count(*) filter (s >= 0.5) > 0 then 'matched' else 'last' end as how from x group by session_id, key""")
def decision_sources(spark, d):
    m = store.current_memories(table(spark, d, "memories")).where("session_id is not null")
    notes = rollups.merged_decisions(m).withColumn("claimed", F.when(F.length("key") % 3 == 0, F.col("turn_index") + 1))
    return rollups.attribute(notes, m.select("session_id", "turn_index", F.transform("decisions", lambda x: F.coalesce(x["what"], F.lit(""))).alias("decisions")))


@query("""with w as (select *, avg(case when event_type = 'error' then 1.0 else 0.0 end) over f as ratio, count(*) over f as n from events window f as (partition by user_id order by ts, event_id rows between 19 preceding and current row)),
h as (select *, n >= 5 and ratio >= 0.3 as high from w) select user_id, event_id, round(ratio, 6) as ratio from (select *, coalesce(lag(high) over (partition by user_id order by ts, event_id), false) as was from h) where high and not was""")
def failure_onsets(spark, d):
    return rollups.failure_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "ratio")


# --- governance ------------------------------------------------------------------------------------------------------

PLAN = ctes("s") + f""", sc as (select id as session_id, tool, native_id, project_id from s where kind = 'subagent' or project_id = 1), mm as (select distinct id as memory_id, session_id from memories where id is not null),
cp as (select session_id, count(*) as copies, sum({utf8('user_prompt')} + {utf8('assistant_response')}) as bytes from filtered_turns join mm using (memory_id) group by session_id), tn as (select session_id, count(*) as turns from mm group by session_id),
plan as (select sc.*, coalesce(turns, 0) as turns, coalesce(copies, 0) as copies, cast(coalesce(bytes, 0) as bigint) as bytes from sc left join tn using (session_id) left join cp using (session_id))"""


def _plan(spark, d):
    return governance.purge_plan(*_t(spark, d, "sessions", "memories", "filtered_turns"), F.coalesce((F.col("kind") == "subagent") | (F.col("project_id") == 1), F.lit(False)))


@query(PLAN + " select * from plan")
def purge_plan(spark, d):
    return _plan(spark, d)


@query(PLAN + " select distinct project_id from plan where project_id not in (select project_id from s where project_id is not null and id not in (select session_id from plan))")
def emptied_projects(spark, d):
    return governance.emptied_projects(table(spark, d, "sessions"), _plan(spark, d)).where("project_id is not null")


@query("""with s0 as (select distinct id, tool, native_id, kind from sessions where id is not null) select distinct id from s0 where (tool, native_id) not in (select tool, native_id from s0 where kind = 'adjudicator')""")
def without_tombstones(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    return governance.without(s, s.where("kind = 'adjudicator'")).select("id")


@query("""with p as (select id from projects where git_remote is null), x as (select id, project_id from sessions where project_id in (select id from p)), y as (select id, session_id from memories where session_id in (select id from x))
select distinct 'projects' as part, id, null::bigint as owner from p union select distinct 'sessions', id, project_id from x union select distinct 'memories', id, session_id from y union select distinct 'filtered_turns', memory_id, memory_id from filtered_turns where memory_id in (select id from y)""")
def project_export(spark, d):
    t = {n: table(spark, d, n) for n in ("projects", "sessions", "memories", "filtered_turns")}
    parts = governance.export(t, t["projects"].where("git_remote is null").select("path"))
    owner = {"projects": F.lit(None), "sessions": F.col("project_id"), "memories": F.col("session_id"), "filtered_turns": F.col("memory_id")}
    out = [df.select(F.lit(n).alias("part"), F.col("memory_id" if n == "filtered_turns" else "id").alias("id"), owner[n].cast("bigint").alias("owner")).distinct() for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(rf"""with c as (select id, unnest(list_filter([case when coalesce(tool in ('claude-code', 'codex', 'opencode'), false) then null else 'tool' end, case when coalesce(segment_index >= 0, false) then null else 'segment' end,
case when coalesce(last_turn_at >= started_at, false) then null else 'order' end, case when coalesce(regexp_matches(source_path, '^/'), false) then null else 'path' end], lambda x: x is not null)) as rule from sessions) select id, rule, count(*) as n from c group by all""")
def validation(spark, d):
    rules = {"tool": F.col("tool").isin("claude-code", "codex", "opencode"), "segment": F.col("segment_index") >= 0, "order": F.col("last_turn_at") >= F.col("started_at"), "path": F.col("source_path").rlike("^/")}
    return governance.violations(table(spark, d, "sessions"), "id", rules).groupBy("id", "rule").agg(F.count("*").alias("n"))


@query(ctes("c") + f""" select memory_id from c where user_prompt is distinct from {uncontrolled('user_prompt')} or assistant_response is distinct from {uncontrolled('assistant_response')}""")
def backfill_changes(spark, d):
    b = store.current_copies(table(spark, d, "filtered_turns"))
    after = b.withColumns({c: E.without_control(c) for c in ("user_prompt", "assistant_response")})
    return governance.changed(b, after, ["memory_id"], ["user_prompt", "assistant_response"])


DISPOSITION = ctes("s") + """, u as (select tool, native_id, min(project_id) as project_id from s group by all), pu as (select distinct tool, native_id from s where kind = 'adjudicator'), st as (select distinct tool, native_id from s where rendered_chars > 10000)
select u.tool, u.native_id, u.project_id, case when pu.tool is not null then 'purged' when p.id is null then 'unconsented' when st.tool is not null then 'existing' else 'new' end as disposition
from u left join pu using (tool, native_id) left join st using (tool, native_id) left join (select id from projects where git_remote is not null) p on p.id = u.project_id"""


@query(DISPOSITION)
def import_dispositions(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    units = s.groupBy("tool", "native_id").agg(F.min("project_id").alias("project_id"))
    consented = table(spark, d, "projects").where("git_remote is not null").select(F.col("id").alias("project_id"))
    return governance.import_disposition(units, s.where("kind = 'adjudicator'"), s.where("rendered_chars > 10000"), consented).select("tool", "native_id", "project_id", "disposition")


# --- texts -----------------------------------------------------------------------------------------------------------

@query("""select doc_id, case when strlen(text) <= 500 then text end as guarded, case when length(text) <= 300 then text else left(text, 100) || chr(10) || '[... ' || (length(text) - 300) || ' characters omitted ...]' || chr(10) || right(text, 200) end as shortened,
case when length(text) <= 300 then text when regexp_matches(right(text, 300), '\\s') then regexp_replace(right(text, 300), '^\\S*\\s', '') else right(text, 300) end as tail,
case when instr(lower(text), 'lease') > 0 then substr(text, greatest(1, instr(lower(text), 'lease') - 40), instr(lower(text), 'lease') + 60 - greatest(1, instr(lower(text), 'lease') - 40)) end as found,
cast(ceil(length(text) / 4.0) as bigint) as tokens from documents""".replace("\\\\", "\\"))
def text_budgets(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", E.byte_guarded(t, 500).alias("guarded"), E.head_and_tail(t, 300).alias("shortened"), E.bounded_tail(t, 300).alias("tail"), E.snippet(t, F.lit("lease"), 40, 60).alias("found"), E.token_estimate(F.length(t)).alias("tokens"))


@query(r"""with x as (select distinct tool, native_id, segment_index from sessions where id is not null) select tool, native_id, segment_index, replace(replace(rtrim(to_base64(encode('["' || tool || '","' || native_id || '","' || segment_index || '"]')), '='), '+', '-'), '/', '_') as public_id from x""")
def public_ids(spark, d):
    s = table(spark, d, "sessions").where("id is not null").select("tool", "native_id", "segment_index").distinct()
    return s.withColumn("public_id", E.public_id(F.col("tool"), F.col("native_id"), F.col("segment_index")))


@query(ctes("s") + rf""" select id, array_to_string(list_filter([title, custom_title, first_prompt_search], lambda x: not {blank('x')}), chr(10)) as source, sha256(array_to_string(list_filter([title, custom_title, first_prompt_search], lambda x: not {blank('x')}), chr(10))) as source_hash from s""")
def embedding_sources(spark, d):
    text = F.array_join(F.filter(F.array("title", "custom_title", "first_prompt_search"), lambda x: ~E.blank(x)), "\n")
    return store.current_sessions(table(spark, d, "sessions")).select("id", text.alias("source"), F.sha2(text, 256).alias("source_hash"))


@query("""with t as (select distinct memory_id, tool_calls from filtered_turns), x as (select memory_id, unnest(tool_calls) as k from t) select k.name as tool_call, count(*) as calls, count(distinct memory_id) as memories, cast(sum(coalesce(len(k.file_paths), 0)) as bigint) as paths from x group by 1""")
def tool_call_counts(spark, d):
    t = table(spark, d, "filtered_turns").select("memory_id", "tool_calls").distinct().select("memory_id", F.explode("tool_calls").alias("k"))
    return t.groupBy(F.col("k.name").alias("tool_call")).agg(F.count("*").alias("calls"), F.countDistinct("memory_id").alias("memories"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("k.file_paths"), F.lit(0)))).cast("bigint").alias("paths"))


@query()
def sanitized_prompts(spark, d):
    c = store.current_copies(table(spark, d, "filtered_turns"))
    p = F.col("user_prompt")
    return c.select("memory_id", shell.has_shell(p).alias("detected"), shell.strip_shell(p).alias("stripped"), shell.escape_shell(p).alias("escaped"))


@query()
def derived_titles(spark, d):
    f = store.first_prompts(*_t(spark, d, "memories", "filtered_turns"))
    return f.select("session_id", titles.derived_title(F.col("document")).alias("title"))


@query()
def reply_units(spark, d):
    c = store.current_copies(table(spark, d, "filtered_turns"))
    return c.select("memory_id", F.posexplode(titles.text_units(F.col("assistant_response"))).alias("position", "unit"))


@query(NOTES + f""", pend as (select session_id as id, arg_max(coalesce(pending_items, []), (turn_index, id)) as p from m where session_id is not null group by 1),
un as (select session_id as id, (0, row_number() over (partition by session_id order by turn_index, key)) as pos, 'Decision: ' || what || chr(10) || 'Why: ' || why as unit from notes where session_id is not null and what is not null and why is not null
union all select id, (1, k), 'Pending: ' || item from (select id, generate_subscripts(p, 1) as k, unnest(p) as item from pend) where item is not null),
o as (select *, row_number() over w as n, count(*) over (partition by id) as al from (select *, list_bool_or(list_transform({_TOKENS!r}, lambda w: contains(lower(unit), w))) as holds from un) window w as (partition by id order by not holds, pos)),
z as (select *, sum(length(unit) + 2) over (partition by id order by n) - 2 + case when al > n then 2 + {len(titles.OMITTED_AFTER)} else 0 end + length('Coverage: stored rollup; ' || (al - n) || ' later evidence units omitted; other session material excluded; relevance unverified.') + 1 as size from o),
f as (select *, bool_and(size <= 800) over (partition by id order by n rows unbounded preceding) as fits from z)
select id, string_agg(unit, chr(10) || chr(10) order by n) || case when max(al) > max(n) then chr(10) || chr(10) || '{titles.OMITTED_AFTER}' else '' end as text, max(al) - max(n) as omitted from f where fits group by id""")
def session_evidence(spark, d):
    from pyspark.sql import Window

    m = store.current_memories(table(spark, d, "memories")).where("session_id is not null")
    notes = rollups.merged_decisions(m).withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index", "key"))).withColumnRenamed("session_id", "id")
    last = m.groupBy(F.col("session_id").alias("id")).agg(F.max_by(F.coalesce("pending_items", F.array().cast("array<string>")), F.struct("turn_index", "id")).alias("p"))
    units = evidence.rollup_units(notes, last.select("id", F.posexplode("p").alias("pos", "item")))
    return evidence.session_evidence(units, _TOKENS)


# --- transcripts and evidence ----------------------------------------------------------------------------------------

@query("""with e as (select user_id as file, event_id as pos, case event_type when 'signup' then 'started' when 'purchase' then 'finished' when 'error' then 'failed' end as state from events)
select file, arg_max(state, pos) as state, count(*) filter (state = 'failed') as failures, count(*) filter (state = 'started') as starts from e where state is not null group by file""")
def lifecycles(spark, d):
    signal = F.when(F.col("event_type") == "signup", "task_started").when(F.col("event_type") == "purchase", "task_complete").when(F.col("event_type") == "error", "error")
    return transcripts.lifecycle(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), signal.alias("signal")))


@query("""with c as (select user_id as file, json_extract_string(props, '$.k') as call_id, arg_max(event_type, event_id) as last from events group by 1, 2)
select file, list_sort(list(call_id)) as open from c where last = 'click' and call_id is not null group by file""")
def open_tool_calls(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.get_json_object("props", "$.k").alias("call_id"), F.when(F.col("event_type") == "click", "use").otherwise("result").alias("kind"))
    return transcripts.open_calls(e)


@query(ctes("s") + """ select native_id, arg_max(title, (last_turn_at is not null, coalesce(last_turn_at, timestamp '1900-01-01'), id)) as title from (select * from s where title is not null) group by native_id""")
def indexed_titles(spark, d):
    s = store.current_sessions(table(spark, d, "sessions")).where("title is not null")
    return transcripts.indexed_titles(s.select("native_id", F.col("last_turn_at").alias("updated_at"), F.col("id").alias("pos"), "title"))


@query("""select o_orderkey as id, o_orderdate as time_updated, o_custkey, coalesce(string_agg(l_returnflag || l_linestatus, chr(10) order by l_shipdate, l_linenumber, l_returnflag || l_linestatus), '') as text from orders left join lineitem on l_orderkey = o_orderkey group by all""")
def messages_with_parts(spark, d):
    o, l = _t(spark, d, "orders", "lineitem")
    m = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time_updated"), "o_custkey")
    p = l.select(F.col("l_orderkey").alias("message_id"), F.lit("text").alias("type"), F.col("l_shipdate").alias("time_created"), F.col("l_linenumber").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return transcripts.messages_with_parts(m, p)


@query("""select * from (select o_orderkey as id, o_orderdate as time_updated from orders where (o_orderdate > timestamp '1997-01-01' or (o_orderdate = timestamp '1997-01-01' and o_orderkey > 100)) and o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') order by o_orderdate, o_orderkey limit 201)""")
def dirty_sessions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time_updated"), "o_orderstatus")
    from datetime import datetime

    return transcripts.dirty_sessions(o.drop("o_orderstatus"), datetime(1997, 1, 1), 100, o.where("o_orderstatus = 'F'"), 200)


EVIDENCE = ctes("m", "c") + f""", t as (select session_id as chat, turn_index as turn, m.id, concat_ws(chr(10), user_prompt, assistant_response) as text from m join c on c.memory_id = m.id where session_id is not null and turn_index is not null),"""


def _chat_turns(spark, d):
    m, c = _t(spark, d, "memories", "filtered_turns")
    return (store.current_memories(m).where("session_id is not null and turn_index is not null").select("id", F.col("session_id").alias("chat"), F.col("turn_index").alias("turn"))
            .join(store.current_copies(c).select(F.col("memory_id").alias("id"), F.concat_ws("\n", "user_prompt", "assistant_response").alias("text")), "id"))


@query(EVIDENCE + f""" h as (select *, len(list_filter({_TOKENS!r}, lambda x: list_contains({components('text')}, x))) as hits from t),
r as (select *, row_number() over w as rank, sum(length(text)) over w as used from h where hits > 0 window w as (partition by chat order by hits desc, turn desc rows unbounded preceding))
select chat, turn, hits, cast(rank as int) as rank from r where rank <= 3 and used <= 3000""")
def chat_evidence(spark, d):
    return evidence.chat_evidence(_chat_turns(spark, d), _TOKENS)


@query(EVIDENCE + """ q as (select id as quote_id, chat, turn, substr(text, 1, 30) as quote from t where text is not null), j as (select q.*, t.turn as pos, t.text, row_number() over (partition by quote_id order by t.turn desc) as n from q join t on t.chat = q.chat and t.turn <= q.turn)
select quote_id, max(case when n <= 64 and contains(text, quote) and quote <> '' then pos end) as found_at, case when max(case when n <= 64 and contains(text, quote) and quote <> '' then pos end) is not null then 'verified' when max(n) > 64 then 'incomplete' else 'absent' end as state from j group by quote_id""")
def verified_quotes(spark, d):
    t = _chat_turns(spark, d)
    return evidence.quotes(t.where("text is not null").select(F.col("id").alias("quote_id"), "chat", "turn", F.substr("text", F.lit(1), F.lit(30)).alias("quote")), t)


@query(ctes("s", "m") + """ select m.id as turn_id, v.session_id as served_id from m join s on s.id = m.session_id join (select distinct session_id, computed_at from session_embeddings where session_id is not null) v on v.session_id = s.id and v.computed_at <= m.turn_started_at""")
def served_before(spark, d):
    s, m, v = _t(spark, d, "sessions", "memories", "session_embeddings")
    turns = store.current_memories(m).join(store.current_sessions(s).select(F.col("id").alias("session_id")), "session_id").select(F.col("id").alias("turn_id"), F.col("session_id").alias("chat"), F.col("turn_started_at").alias("ended_at"))
    served = v.where("session_id is not null").select("session_id", "computed_at").distinct().select(F.col("session_id").alias("chat"), F.col("session_id").alias("served_id"), F.col("computed_at").alias("served_at"))
    return evidence.served_before(turns, served)


@query("""with g as (select user_id || '-' || cast(ts as date) as chat, json_extract_string(props, '$.k') as call_id, count(distinct (event_type, value > 50)) as kinds, min(value > 50) as turn, min(event_type) as body from events group by 1, 2)
select chat, call_id, turn, body from g where kinds = 1 and chat not in (select chat from g where kinds > 1)""")
def receipts(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("chat"), F.get_json_object("props", "$.k").alias("call_id"), (F.col("value") > 50).alias("turn"), F.col("event_type").alias("body"))
    return evidence.record_receipts(e)


@query(ctes("v") + """ select session_id, truncated from (select session_id, row_number() over w as rn, count(*) over (partition by model, model_revision) > 200 as truncated from v window w as (partition by model, model_revision order by session_id desc)) where rn <= 200""")
def capped_scan(spark, d):
    return evidence.scan_cap(vectors.fresh(table(spark, d, "session_embeddings")), ["model", "model_revision"], [F.desc("session_id")], 200).select("session_id", "truncated")


@query()
def fitting_turns(spark, d):
    t = _chat_turns(spark, d).withColumn("n", F.coalesce(F.length("text"), F.lit(0))).withColumn("back", -F.col("turn"))
    return evidence.fits(t, "chat", ["back", "id"], "n", 128, 1500).select("id")


@query(ctes("c") + """, o as (select *, greatest(0, coalesce(length(user_prompt), 0) + coalesce(length(assistant_response), 0) - 600) as omitted from c)
select memory_id, omitted, case when least(omitted, coalesce(length(user_prompt), 0)) > 0 then right(user_prompt, length(user_prompt) - least(omitted, length(user_prompt))) else user_prompt end as user_prompt,
case when omitted - least(omitted, coalesce(length(user_prompt), 0)) > 0 then right(assistant_response, length(assistant_response) - (omitted - least(omitted, coalesce(length(user_prompt), 0)))) else assistant_response end as assistant_response from o""")
def bounded_copies(spark, d):
    c = store.current_copies(table(spark, d, "filtered_turns"))
    return evidence.bounded_projection(c, ["user_prompt", "assistant_response"], 600).select("memory_id", "omitted", "user_prompt", "assistant_response")


@query(ctes("c") + rf""" select memory_id, concat_ws(chr(10) || chr(10), case when coalesce(omitted_before_chars, 0) > 0 then '[... ' || omitted_before_chars || ' characters omitted ...]' end,
case when not {blank('user_prompt')} then '**User**' || chr(10) || chr(10) || {trimmed('user_prompt')} end, case when not {blank('assistant_response')} then '**Assistant**' || chr(10) || chr(10) || {trimmed('assistant_response')} end) as rendered from c""")
def rendered_turns(spark, d):
    return evidence.rendered(store.current_copies(table(spark, d, "filtered_turns"))).select("memory_id", "rendered")


@query(ctes("s") + """, x as (select id, case when segment_index > 0 then (select min(b.id) from s b where b.tool = a.tool and b.native_id = a.native_id and b.segment_index = 0) end as parent_id from s a),
k as (select parent_id, list_sort(list(id)) as children from x where parent_id in (select id from x) group by parent_id) select x.id, coalesce(children, []) as children from x left join k on k.parent_id = x.id where x.parent_id is null or x.parent_id not in (select id from x)""")
def attached_children(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    first = s.where("segment_index = 0").groupBy("tool", "native_id").agg(F.min("id").alias("first"))
    return evidence.attach_children(s.join(first, ["tool", "native_id"], "left").select("id", F.when(F.col("segment_index") > 0, F.col("first")).alias("parent_id")))


@query(ctes("s") + """ select count(*) as total, count(*) filter (coalesce(last_turn_at, started_at) >= timestamp '2025-12-01' - interval 7 day) as recent, count(distinct project_id) as projects from s where kind is distinct from 'adjudicator'""")
def recent_counts(spark, d):
    s = store.current_sessions(table(spark, d, "sessions")).where(store.served_kind())
    return s.agg(F.count("*").alias("total"), F.count_if(F.coalesce("last_turn_at", "started_at") >= F.lit("2025-11-24").cast("timestamp_ntz")).alias("recent"), F.countDistinct("project_id").alias("projects"))


@query(NOTES + """ select session_id, key, turn_index from (select *, row_number() over (partition by session_id order by turn_index desc, key desc) rn from notes) where rn <= 3""")
def newest_decisions(spark, d):
    n = rollups.merged_decisions(store.current_memories(table(spark, d, "memories")))
    return store.newest_per_key(n, ["session_id"], [F.desc("turn_index"), F.desc("key")], 3).select("session_id", "key", "turn_index")

"""Queries of serving, retention and upkeep, and the SQL that gives the same rows.

Where the given tables hold nothing of a kind, a comment says what stands for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators import governance, ledger, projects, retention, rollups, serving, store, transcripts, upkeep, vectors
from tidemark.plans.core_queries import BY_CHAT, CTE, GROUPS, NOTES, ROOTS, STATES, _charges, _known, _roots, _t, blank, ctes, query, size, uncontrolled
from tidemark.runtime import table

# --- serving ---------------------------------------------------------------------------------------------------------


@query(ctes("s") + """, x as (select a.native_id, a.project_id, b.id, coalesce(b.last_turn_at, b.last_ingested_at, b.started_at) as ended from (select distinct native_id, project_id from s where project_id is not null) a join s b on b.project_id = a.project_id and b.native_id <> a.native_id
where b.kind is distinct from 'adjudicator' and coalesce(b.last_turn_at, b.last_ingested_at, b.started_at) is not null) select native_id, project_id, arg_max(id, (ended, -id)) as id from x group by all""")
def newest_activity(spark, d):
    s = table(spark, d, "sessions")
    return serving.newest_activity(s, store.current_sessions(s).where("project_id is not null").select("native_id", "project_id").distinct())


@query(STATES + f""", f as (select session_id, struct_extract(min(struct_pack(turn_index, id, reingested_at)), 'turn_index') as turn_index, struct_extract(min(struct_pack(turn_index, id, reingested_at)), 'id') as id from m where session_id is not null group by session_id)
select f.session_id, f.id, case when turn_index > 0 then 'not_first' when state = 'missing' then 'missing' when not coalesce(included, false) then 'excluded' when state = 'outdated' then 'outdated' when state = 'superseded' then 'superseded' when coverage = 'truncated' then 'truncated'
when {blank('user_prompt')} or {blank('assistant_response')} then 'blank' end as reason from f join st on st.id = f.id left join c on c.memory_id = f.id""")
def first_interactions(spark, d):
    return serving.first_interactions(*_t(spark, d, "memories", "filtered_turns"), version=3)


@query(ctes("m") + f""" select id, list_filter(list_concat(list_concat(flatten(list_transform(coalesce(decisions, []), lambda x: [x.what, x.why])), coalesce(pending_items, [])), coalesce(files_touched, [])), lambda x: not {blank('x')}) as fields from m""")
def recall_fields(spark, d):
    return serving.recall_fields(table(spark, d, "memories"))


@query(ctes("s", "m") + """, p as (select session_id as id, max(turn_index) filter (summarizer_status = 'ok') as through from m where session_id is not null group by 1), n as (select p.id, count(*) filter (turn_index > coalesce(through, -1)) as newer from p join m on m.session_id = p.id group by 1)
select s.id, case when strlen(coalesce(custom_title, title)) <= 200 then coalesce(custom_title, title) end as title, through, coalesce(newer, 0) as newer from s left join p using (id) left join n using (id)""")
def capsules(spark, d):
    return serving.capsules(*_t(spark, d, "sessions", "memories"))


@query(ctes("s") + """ select project_id, cast(n as int) as n, id from (select *, row_number() over (partition by project_id order by coalesce(last_turn_at, last_ingested_at, started_at) desc nulls last, id desc) as n from s where kind is distinct from 'adjudicator') where n <= 20""")
def shown_lists(spark, d):
    return serving.shown_lists(table(spark, d, "sessions"))


# the session's first prompt stands for a summary
@query(NOTES + f""", {CTE['s']}, u as (select session_id, key, sum(length(what) + coalesce(length(why), 0)) over (partition by session_id order by turn_index desc, key desc rows unbounded preceding) as used from notes)
select u.session_id, key, used + coalesce(least(240, coalesce(length(first_prompt_search), 0)), 0) <= 600 as kept from u left join s on s.id = u.session_id where u.session_id is not null""")
def bounded_notes(spark, d):
    s, m = _t(spark, d, "sessions", "memories")
    notes = rollups.merged_decisions(store.current_memories(m).where("session_id is not null"))
    return serving.bounded_notes(notes, store.current_sessions(s).select(F.col("id").alias("session_id"), F.col("first_prompt_search").alias("summary")), 600)


# a sign-up stands for a turn's start, an error for a marker
@query("""with g as (select *, event_type = 'signup' as b, coalesce(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as grp from events)
select event_id, bool_or(event_type = 'error') over (partition by user_id, grp) as marked from g qualify b""")
def resume_markers(spark, d):
    e = table(spark, d, "events").withColumns({"boundary": F.col("event_type") == "signup", "marker": F.col("event_type") == "error"})
    return serving.resume_markers(e, "user_id", ["ts", "event_id"]).select("event_id", "marked")


@query("""select memory_id, left(sha256(right(user_prompt, 4096)), 16) as mark, right(concat_ws(chr(10), user_prompt, assistant_response), 4000) as newest, sha256(right(concat_ws(chr(10), user_prompt, assistant_response), 4000)) as newest_hash,
case when length(u) <= 80 then u else left(u, 80) || '~' || left(sha256(u), 12) end as shown from (select *, """ + uncontrolled("user_prompt") + """ as u from (select distinct memory_id, user_prompt, assistant_response from filtered_turns))""")
def text_marks(spark, d):
    t = table(spark, d, "filtered_turns").select("memory_id", "user_prompt", "assistant_response").distinct()
    newest = E.newest_text("user_prompt", "assistant_response")
    return t.select("memory_id", E.fingerprint("user_prompt").alias("mark"), newest.alias("newest"), F.sha2(newest, 256).alias("newest_hash"), E.discriminator("user_prompt").alias("shown"))


@query("select event_id, cast(epoch_us(ts) // 1000 as bigint) as millis, cast(null as bigint) as wrong from events")
def iso_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", E.iso_millis(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("millis"), E.iso_millis(F.date_format("ts", "dd.MM.yyyy HH:mm")).alias("wrong"))


@query(r"""with x as (select doc_id, case when json_valid(text) and json_type(text) = 'ARRAY' then text end as a from documents where text is not null)
select doc_id, coalesce(list_filter(list_transform(from_json(a, '["json"]'), lambda v: case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') end), lambda v: v is not null), []) as strings from x""")
def json_strings(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", E.json_strings("text").alias("strings"))


@query("select memory_id, list_filter(p, lambda x, i: list_position(p, x) = i) as paths from (select distinct id as memory_id, coalesce(files_touched, []) as p from memories where id is not null)")
def distinct_paths(spark, d):
    return table(spark, d, "memories").where("id is not null").select(F.col("id").alias("memory_id"), F.array_distinct(F.coalesce("files_touched", F.array().cast("array<string>"))).alias("paths")).distinct()


# --- sets ------------------------------------------------------------------------------------------------------------

@query("select project_id from session_embeddings union select project_id from memories")
def projects_with_content(spark, d):
    v, m = _t(spark, d, "session_embeddings", "memories")
    return v.select("project_id").distinct().unionByName(m.select("project_id").distinct()).distinct()


# the adjudicator's chats stand for purged ones, those of subagents for incognito ones
@query(ctes("s") + " select tool, native_id, 'purged' as why from s where kind = 'adjudicator' union all select tool, native_id, 'incognito' from s where kind = 'subagent'")
def blocked_transcripts(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    mark = lambda kind, why: s.where(F.col("kind") == kind).select("tool", "native_id", F.lit(why).alias("why"))
    return mark("adjudicator", "purged").unionByName(mark("subagent", "incognito"))


@query(ctes("s") + """ select distinct m.id from memories m where m.id is not null and m.session_id in (select id from s where (tool, native_id) not in (select tool, native_id from s where kind = 'subagent'))""")
def without_incognito(spark, d):
    s, m = _t(spark, d, "sessions", "memories")
    s = store.current_sessions(s)
    kept = upkeep.restored(s, s.where("kind = 'subagent'"))
    return m.where("id is not null").select("id", "session_id").join(kept.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("id").distinct()


@query("select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier where s_suppkey not in (select c_custkey from customer)")
def insert_new(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    c, s = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(store.insert_new(c, s, ["k"]))


@query(ctes("s", "m") + " select m.id, s.tool, native_id, segment_index, turn_index from m join s on s.id = m.session_id")
def turns_of_chats(spark, d):
    return governance.current_turns_of(*_t(spark, d, "memories", "sessions")).select("id", "tool", "native_id", "segment_index", "turn_index")


@query(ctes("c") + " select memory_id from c where not contains(concat_ws(chr(10), user_prompt, assistant_response), 'lease')")
def without_own_output(spark, d):
    return transcripts.without_own_output(store.current_copies(table(spark, d, "filtered_turns")), "lease", "user_prompt", "assistant_response").select("memory_id")


@query("""with p as (select o_orderkey as id from orders where o_orderdate > timestamp '1998-06-01' order by o_orderdate, o_orderkey limit 101), r as (select o_orderkey as id from orders where o_orderstatus = 'P' and o_orderkey not in (select id from p) order by o_custkey, o_orderkey limit 32)
select id, false as retry from p union all select id, true from r""")
def pages_with_retries(spark, d):
    o = table(spark, d, "orders")
    page = o.where("o_orderdate > timestamp '1998-06-01'").orderBy("o_orderdate", "o_orderkey").limit(101).select(F.col("o_orderkey").alias("id"))
    return transcripts.with_retries(page, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rank")))


# events of a user stand for the records of a file
@query("""select user_id as file, arg_max(trim(event_type), event_id) as title from events where trim(event_type) <> '' group by 1""")
def last_titles(spark, d):
    return transcripts.last_title(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.col("event_type").alias("title")))


@query("""select user_id as file, coalesce(arg_min(case event_type when 'click' then 'event_msg' when 'purchase' then 'response_item' end, event_id) filter (event_type in ('click', 'purchase')), 'response_item') as opener from events group by 1""")
def turn_openers(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", F.struct(F.lit("event_msg").alias("type"), F.lit("user_message").alias("sub"), F.lit(None).cast("string").alias("role"))).when(F.col("event_type") == "purchase", F.struct(F.lit("response_item").alias("type"), F.lit(None).cast("string").alias("sub"), F.lit("assistant").alias("role")))
    return transcripts.turn_opener(e.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), kind.alias("k")).select("file", "pos", "k.*"))


@query(ctes("s") + """ select id, case when regexp_matches(lower(surface), 'desktop|app|vscode|ide') then 'desktop' when regexp_matches(lower(surface), 'cli|exec|tui|terminal|sdk') then 'cli' end as shown,
case when coalesce(kind = 'subagent', false) or coalesce(kind, '') = 'subagent' then 'subagent' when git_branch is not null and segment_index > 0 then 'fork-copy' else 'primary' end as first_kind from s""")
def session_kinds(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    forked = F.when(F.col("segment_index") > 0, F.col("git_branch"))
    return s.select("id", transcripts.surface(F.col("surface")).alias("shown"), transcripts.session_kind(F.col("kind"), forked, F.col("kind") == "subagent").alias("first_kind"))


# errors stand for failed ends, sign-ups for the file that is there, purchases for closed turns
@query("""with o as (select user_id as session_id, ts as seen, json_extract_string(props, '$.k') as source_id from events where event_type = 'error'), l as (select session_id, max(seen) as staged_at, arg_max(source_id, (seen, source_id)) as source_id from o group by 1),
n as (select user_id as session_id, max(json_extract_string(props, '$.k')) as is_now from events where event_type = 'signup' group by 1), d as (select user_id as session_id, max(ts) as done from events where event_type = 'purchase' group by 1)
select l.session_id, staged_at, case when done >= staged_at then 'closed' when l.source_id is distinct from is_now then 'invalid' when staged_at + interval 5 minute > timestamp '2024-01-20' then 'waiting' else 'open' end as state from l left join n using (session_id) left join d using (session_id)""")
def staged_open_turns(spark, d):
    e = table(spark, d, "events").withColumn("source_id", F.get_json_object("props", "$.k")).withColumnsRenamed({"user_id": "session_id", "ts": "at"})
    of = lambda kind: e.where(F.col("event_type") == kind)
    return transcripts.staged_open_turns(of("error").select("session_id", "at", "source_id"), of("signup").select("session_id", "source_id"), of("purchase").select("session_id", "at"), F.lit("2024-01-20").cast("timestamp_ntz"))


# sign-ups stand for compactions, the kinds of clicks and errors for summaries
@query("""with r as (select user_id as file, event_id as pos, event_type = 'signup' as c, case when event_type in ('click', 'error') then json_extract_string(props, '$.k') end as summary from events), l as (select file, max(pos) filter (c) as since from r group by 1),
g as (select r.file, count(distinct summary) as n, min(summary) as summary from r join l using (file) where summary is not null and pos >= coalesce(since, 0) group by 1)
select l.file, case when n is null then 'none' when n > 1 then 'ambiguous' when trim(summary) = '' then 'blank' when length(summary) > 1 then 'oversize' else 'found' end as state, case when n = 1 and trim(summary) <> '' and length(summary) <= 1 then summary end as summary from l left join g using (file)""")
def compact_summaries(spark, d):
    k = F.when(F.col("event_type").isin("click", "error"), F.get_json_object("props", "$.k"))
    return transcripts.compact_summaries(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), (F.col("event_type") == "signup").alias("compacted"), k.alias("summary")), 1)


# --- retention -------------------------------------------------------------------------------------------------------

# the first main session of a project stands for the parent of its subagents' sessions; sessions without a last turn have an open one; older copies are let pass
PARENTS = """par as (select a.id as session_id, b.id as parent_id from s a join (select project_id, min(id) as id from s where kind = 'main' group by 1) b using (project_id) where a.kind = 'subagent'),
refd as (select distinct p.tool, p.native_id from par join s c on c.id = par.session_id join s p on p.id = par.parent_id where (c.tool, c.native_id) <> (p.tool, p.native_id))"""
ELIGIBLE = STATES + f""", {CTE['s']}, {PARENTS}, {ROOTS}, cst as (select p.path, coalesce(arg_max(state, len(root)), 'pending') as state from (select distinct path from projects where path is not null) p left join b on p.path = b.root or starts_with(p.path, b.root || '/') group by p.path),
cap as (select session_id, case when count(*) filter (state in ('missing', 'superseded')) > 0 then 'disabled_gap' when count(*) filter (coverage = 'truncated') > 0 then 'complete_truncated' else 'complete' end as state from st group by 1),
el as (select tool, native_id, case when bool_or(last_turn_at is null) then 'open_turn' when bool_or(not coalesce(cap.state in ('complete', 'complete_truncated'), false)) then 'capture_incomplete' when bool_or(last_ingested_at is null) or bool_or(p.path is null) or (tool, native_id) in (select tool, native_id from refd) then 'identity_uncertain'
when timestamp '2025-12-09' - max(last_ingested_at) < interval 24 hour then 'active_writer' when bool_or(p.path is not null and coalesce(cst.state, 'pending') = 'pending') then 'consent_unsettled' end as ineligible
from s left join cap on cap.session_id = s.id left join projects p on p.id = s.project_id left join cst on cst.path = p.path group by tool, native_id)"""


def _parents(s):
    main = s.where("kind = 'main'").groupBy("project_id").agg(F.min("id").alias("parent_id"))
    return s.where("kind = 'subagent'").join(main, "project_id").select(F.col("id").alias("session_id"), "parent_id")


def _eligible(spark, d):
    s, m, t, p = _t(spark, d, "sessions", "memories", "filtered_turns", "projects")
    s = store.current_sessions(s)
    states = store.copy_state(m, t, version=3).withColumn("state", F.when(F.col("state") == "outdated", "current").otherwise(F.col("state")))
    caps = store.capture_states(states, s.limit(0).select(F.col("id").alias("session_id")))
    consents = projects.consent(p.where("path is not null"), _roots(p))
    return retention.eligibility(s, caps, s.where("last_turn_at is null"), p, consents, retention.referenced_parents(s, _parents(s)), F.lit("2025-12-09").cast("timestamp"))


@query(ELIGIBLE + " select * from el")
def retention_eligibility(spark, d):
    return _eligible(spark, d)


@query(ctes("s") + f", {PARENTS} select * from refd")
def referenced_parents(spark, d):
    s = store.current_sessions(table(spark, d, "sessions"))
    return retention.referenced_parents(s, _parents(s))


@query(BY_CHAT.replace(CTE["s"], ELIGIBLE.removeprefix("with "), 1) + """, f as (select u.* from u join el using (tool, native_id) where ineligible is null), need as (select 100000 as n),
k as (select tool, native_id, bytes, cast(coalesce(sum(bytes) over (order by started_at is null, started_at, tool, native_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from f)
select k.*, 'cleanup' as outcome from k, need where before < n and (select sum(bytes) from f) >= n""")
def retention_cleanup(spark, d):
    units = ledger.by_chat(_charges(spark, d), table(spark, d, "sessions"))
    # a small store, so small bounds: 100 kB must go
    outcome, taken = retention.plan(units, _eligible(spark, d), stored=1_000_000, before=950_000, write=50_000, capacity=1_000_000, warning=900_000, target=950_000)
    return taken.select("tool", "native_id", "bytes", F.col("before").cast("bigint").alias("before"), F.lit(outcome).alias("outcome"))


@query()
def usage_warnings(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("at"), (F.col("value") * 10).cast("bigint").alias("used"))
    return retention.warnings(e, "user_id", "at", "used", 800, 950)


# projects with a remote are there, those without a root are gone, others cannot be seen; roots are there; sources of unnamed sessions are gone
@query(ctes("s") + """, seen as (select path, case when git_remote is not null then 'directory' when git_root is null then 'missing' else 'unresolved' end as state from projects where path is not null), roots as (select distinct git_root as path, 'directory' as state from projects where git_root is not null and git_root not in (select path from seen)),
obs as (select * from seen union all select * from roots), src as (select source_path as path, case when bool_or(title is null) then 'missing' else 'file' end as state from s where source_path is not null group by 1),
one as (select p.id as project_id, case h.state when 'directory' then 'associated' when 'missing' then case when git_root is null or git_root = p.path then 'candidate' else case coalesce(r.state, 'unresolved') when 'missing' then 'candidate' when 'directory' then 'relocated' else 'unresolved' end end else 'unresolved' end as one
from projects p left join obs h on h.path = p.path left join obs r on r.path = p.git_root),
g as (select tool, native_id, coalesce(bool_or(coalesce(one, 'unresolved') = 'unresolved'), false) as un, bool_or(coalesce(one, 'unresolved') = 'relocated') as re, bool_or(coalesce(one, 'unresolved') = 'associated') as a, bool_or(coalesce(one, 'unresolved') = 'candidate') as ca, count(distinct project_id) as owners,
count(distinct source_path) + max(case when source_path is null then 1 else 0 end) as origins, min(source_path) as source from s left join one using (project_id) group by tool, native_id),
f as (select *, case when origins <> 1 or un then 'unresolved' when re then 'relocated' when a then 'associated' else 'candidate' end as first from g), x as (select *, case when first <> 'candidate' and ((ca and origins = 1) or owners > 1) then 'mixed' else first end as second from f)
select tool, native_id, case when second in ('associated', 'relocated') and src.state = 'missing' then 'candidate' when second in ('associated', 'relocated') and coalesce(src.state = 'unresolved', true) then 'unresolved' else second end as outcome from x left join src on src.path = x.source""")
def orphan_chats(spark, d):
    s, p = _t(spark, d, "sessions", "projects")
    s = store.current_sessions(s)
    state = F.when(F.col("git_remote").isNotNull(), "directory").when(F.col("git_root").isNull(), "missing").otherwise("unresolved")
    seen = p.where("path is not null").select("path", state.alias("state"))
    roots = p.where("git_root is not null").select(F.col("git_root").alias("path"), F.lit("directory").alias("state")).distinct().join(seen, "path", "left_anti")
    sources = s.where("source_path is not null").groupBy(F.col("source_path").alias("path")).agg(F.when(F.max(F.col("title").isNull()), "missing").otherwise("file").alias("state"))
    return retention.orphans(s, p, seen.unionByName(roots), sources, s.limit(0))


@query(BY_CHAT + """ select tool, native_id, started_at, bytes, (select count(*) from u) as chats, (select cast(sum(bytes) as bigint) from u) as all_bytes from u order by started_at desc nulls last, tool, native_id limit 10""")
def removal_report(spark, d):
    units = ledger.by_chat(_charges(spark, d), table(spark, d, "sessions"))
    return upkeep.removal_report(units.select("tool", "native_id", "started_at", "bytes"))


# --- upkeep ----------------------------------------------------------------------------------------------------------

# every project is matched with the others
@query(f"""with k as (select id, unnest([{{'rank': 1, 'key': {_known('git_remote')}}}, {{'rank': 2, 'key': {_known('git_root_commit')}}}, {{'rank': 3, 'key': {_known('git_root')}}}, {{'rank': 4, 'key': path}}]) as x from projects), h as (select a.id, a.x.rank as rank, b.id as local_id from k a join k b on a.x.rank = b.x.rank and a.x.key = b.x.key and a.id <> b.id),
g as (select id, rank, min(local_id) as local_id, count(distinct local_id) as n from h group by id, rank), z as (select id, min(rank) as rank from g group by id)
select p.id, cast(g.rank as int) as rank, g.local_id, case when g.id is null then 'unmatched' when n > 1 then 'ambiguous' else 'matched' end as state from projects p left join z using (id) left join g on g.id = z.id and g.rank = z.rank""")
def import_matches(spark, d):
    p = table(spark, d, "projects")
    return upkeep.import_matches(p, p)


@query(GROUPS + """, can as (select group_key, arg_min(id, (len(list_filter(string_split(path, '/'), lambda x: x <> '')), path, id)) as new from g join projects using (id) group by 1), map as (select g.id as old, can.new from g join can using (group_key)), s as (select distinct id, project_id from sessions where id is not null)
select coalesce(new, project_id) as project_id, count(*) as sessions from s left join map on map.old = s.project_id group by 1""")
def rekeyed_sessions(spark, d):
    p, s = _t(spark, d, "projects", "sessions")
    mapping = projects.groups(p).join(projects.canonical(p).select("group_key", F.col("id").alias("new")), "group_key").select(F.col("id").alias("old"), "new")
    return upkeep.rekeyed(s.where("id is not null").select("id", "project_id").distinct(), mapping, "project_id").groupBy("project_id").agg(F.count("*").alias("sessions"))


# the source path of a session stands for the directory it was started in
@query(f"""with o as (select coalesce({_known('git_root')}, path) as key, first_seen_at, last_seen_at, true as known from projects union all select source_path, started_at, started_at, false from sessions where started_at is not null)
select key, coalesce(min(first_seen_at) filter (known), min(first_seen_at)) as first_seen_at, max(last_seen_at) as last_seen_at, bool_or(known) as known from o where key is not null group by key""")
def upserted_projects(spark, d):
    p, s = _t(spark, d, "projects", "sessions")
    return upkeep.upsert_projects(p, s.where("started_at is not null").select(F.col("source_path").alias("path"), F.lit(None).cast("string").alias("git_root"), F.col("started_at").alias("at")))


# clicks stand for what is stored, views for what comes in
@query("""with k as (select event_type, user_id, json_extract_string(props, '$.k') as k, value > 50 as body from events), o as (select user_id, k, min(body) as was from k where event_type = 'click' group by all), n as (select user_id, k, min(body) as is_, max(body) as also from k where event_type = 'signup' group by all)
select n.user_id, n.k, case when is_ <> also then 'conflict' when o.user_id is null then 'stored' when is_ = was then 'duplicate' else 'conflict' end as outcome from n left join o on o.user_id = n.user_id and o.k = n.k where n.k is not null""")
def receipt_outcomes(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").alias("k"), (F.col("value") > 50).alias("body")).where("k is not null")
    return upkeep.outcomes(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), ["user_id", "k"], "body")


@query("""with r as (select user_id as request_id, min(ts) as issued_at from events where event_type = 'signup' group by 1) select request_id, arg_min(event_id, (ts, event_id)) as attempt_id from r join events e on e.user_id = r.request_id and e.event_type = 'purchase' and e.ts >= issued_at group by 1""")
def consumed_requests(spark, d):
    e = table(spark, d, "events")
    requests = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("request_id")).agg(F.min("ts").alias("issued_at"))
    return upkeep.consumed(requests, e.where("event_type = 'purchase'").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("attempt_id"), F.col("ts").alias("at")))


@query(ctes("s", "m", "c") + """, v as (select session_id as id, max(filter_version) as version from m join c on c.memory_id = m.id group by 1) select s.id, case when version is null then 'missing' else 'outdated' end as reason from s left join v using (id) where version is distinct from 3""")
def rollup_rebuilds(spark, d):
    s, m, c = _t(spark, d, "sessions", "memories", "filtered_turns")
    v = (store.current_memories(m).select("id", F.col("session_id").alias("s")).join(store.current_copies(c).select(F.col("memory_id").alias("id"), "filter_version"), "id")
         .groupBy(F.col("s").alias("id")).agg(F.max("filter_version").alias("version")))
    return upkeep.rebuilds(store.current_sessions(s), v, 3)


@query(ctes("s") + f""", src as (select id, project_id, array_to_string(list_filter([title, custom_title, first_prompt_search], lambda x: not {blank('x')}), chr(10)) as source from s),
v as (select session_id as id, source_hash, project_id as owner from (select *, row_number() over (partition by session_id order by computed_at desc nulls last, model_revision desc nulls last, source_hash desc nulls last) rn from session_embeddings where session_id is not null) where rn = 1)
select src.id, case when source = '' then 'ineligible' when v.id is null then 'missing' when owner is distinct from project_id then 'moved' when source_hash is distinct from sha256(source) then 'changed' else 'current' end as status from src left join v using (id)""")
def embedding_pass(spark, d):
    s, v = _t(spark, d, "sessions", "session_embeddings")
    text = F.array_join(F.filter(F.array("title", "custom_title", "first_prompt_search"), lambda x: ~E.blank(x)), "\n")
    newest = store.first_by(v.where("session_id is not null"), ["session_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("model_revision"), F.desc_nulls_last("source_hash")])
    return upkeep.embedding_pass(store.current_sessions(s).select("id", "project_id", text.alias("source"), F.sha2(text, 256).alias("source_hash")), newest)


@query(ctes("s", "v") + " select v.session_id from v join (select session_id, project_id from (select *, row_number() over (partition by session_id order by computed_at desc nulls last, model_revision desc nulls last, source_hash desc nulls last) rn from session_embeddings where session_id is not null) where rn = 1) o using (session_id) join s on s.id = v.session_id and s.project_id = o.project_id")
def owned_vectors(spark, d):
    s, v = _t(spark, d, "sessions", "session_embeddings")
    return upkeep.owned_vectors(vectors.fresh(v).join(store.first_by(v.where("session_id is not null"), ["session_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("model_revision"), F.desc_nulls_last("source_hash")]).select("session_id", "project_id"), "session_id"), store.current_sessions(s)).select("session_id")


@query(ctes("s", "m") + " select s.tool, native_id, max(turn_index) + 1 as offset from m join s on s.id = m.session_id group by all".replace("as offset", 'as "offset"'))
def turn_offsets(spark, d):
    s, m = _t(spark, d, "sessions", "memories")
    return upkeep.turn_offsets(store.current_memories(m), store.current_sessions(s))


@query("""with r as (select user_id, json_extract_string(props, '$.k') as k, event_type as body, row_number() over (partition by user_id, json_extract_string(props, '$.k') order by ts, event_id) as n from events), f as (select user_id, k, body as first from r where n = 1)
select r.user_id, r.k, first as body, count(*) filter (body = first) - 1 as same, count(*) filter (body <> first) as other from r join f on f.user_id = r.user_id and f.k is not distinct from r.k group by all""")
def recorded_injections(spark, d):
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("body"), "ts", "event_id")
    return upkeep.first_of(e, ["user_id", "k"], [F.asc("ts"), F.asc("event_id")])


# the documents of a project stand for its rules
@query()
def admitted_rules(spark, d):
    return upkeep.admitted_rules(table(spark, d, "documents").select("doc_id", "project_id", "text"), "project_id", "doc_id", "text").select("doc_id", "outcome")

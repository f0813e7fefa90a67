"""Evidence of a chat: turns that answer a question, quotes and where they stand, what was served before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions.titles import OMITTED_AFTER


def chat_evidence(turns: DataFrame, tokens: list[str], candidates: int = 12, shown: int = 3, budget: int = 3000) -> DataFrame:
    """Per chat the turns that hold most of the wanted tokens: the best ``candidates``, of these the first ``shown`` that fit the budget, newest first among equals.

    ``turns`` has ``chat, turn, text``. A turn that does not fit ends the list.
    """
    wanted = F.array(*[F.lit(t) for t in tokens])
    t = turns.withColumn("hits", F.size(F.array_intersect(wanted, E.components("text")))).where("hits > 0")
    w = Window.partitionBy("chat").orderBy(F.desc("hits"), F.desc("turn"))
    t = t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates)
    used = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("used", used).where((F.col("rank") <= shown) & (F.col("used") <= budget)).select("chat", "turn", "hits", "rank")


def quotes(quoted: DataFrame, turns: DataFrame, newest: int = 64) -> DataFrame:
    """Where quotes stand: per quote the newest turn of its chat, at or before the reporting turn, whose text holds it exactly.

    ``quoted`` has ``quote_id, chat, turn, quote``, ``turns`` ``chat, turn,
    text``. Only the ``newest`` turns before a report are looked at; if there
    were more and none held it, the state is ``incomplete``. Turns are numbered
    first, and a quote meets only the two blocks of ``newest`` turns that hold
    its range, so its chat may be as long as it likes.
    """
    mine = turns.select("chat", F.col("turn").alias("at"), "text", F.lit(None).cast("string").alias("quote_id"))
    asks = quoted.select("chat", F.col("turn").alias("at"), F.lit(None).cast("string").alias("text"), F.col("quote_id").cast("string").alias("quote_id"))
    w = Window.partitionBy("chat").orderBy("at", F.col("quote_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = mine.unionByName(asks).withColumn("pos", F.count_if(F.col("quote_id").isNull()).over(w))
    at = numbered.where("quote_id is null").select("chat", "at", "text", "pos", F.floor(F.col("pos") / newest).alias("block"))
    upto = numbered.where("quote_id is not null").select("quote_id", F.col("pos").alias("upto"))
    q = quoted.withColumn("key", F.col("quote_id").cast("string")).join(upto.withColumnRenamed("quote_id", "key"), "key").drop("key")
    last = F.floor(F.col("upto") / newest)
    near = q.withColumn("block", F.explode(F.array(last - 1, last))).join(at, ["chat", "block"]).where((F.col("pos") <= F.col("upto")) & (F.col("pos") > F.col("upto") - newest))
    found = near.where(F.contains("text", "quote") & (F.col("quote") != "")).groupBy("quote_id").agg(F.max("at").alias("found_at"))
    g = q.select("quote_id", "upto").join(found, "quote_id", "left")
    return g.select("quote_id", "found_at", F.when(F.col("found_at").isNotNull(), "verified").when(F.col("upto") > newest, "incomplete").otherwise("absent").alias("state"))


def served_before(turns: DataFrame, served: DataFrame) -> DataFrame:
    """Turns with what was served to their chat up to their end: ``turn_id, served_id`` by equality on the chat and order in time."""
    return turns.join(served, "chat").where(F.col("served_at") <= F.col("ended_at")).select("turn_id", "served_id")


def record_receipts(batch: DataFrame) -> DataFrame:
    """Receipts of a batch, one per call; calls that come with different bodies or turns reject all of their chat."""
    per = batch.groupBy("chat", "call_id").agg(F.countDistinct("body", "turn").alias("kinds"), F.min("turn").alias("turn"), F.min("body").alias("body"))
    bad = per.where("kinds > 1").select("chat").distinct()
    return per.where("kinds = 1").join(bad, "chat", "left_anti").drop("kinds")


def complete(stored: DataFrame, seen: DataFrame, keys: list[str], columns: list[str]) -> bool:
    """Whether every stored row was seen again with the same values."""
    s = stored.select(*keys, F.struct(*columns).alias("a"))
    return s.join(seen.select(*keys, F.struct(*columns).alias("b")), keys, "left").where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def scan_cap(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The newest ``cap`` rows in scope of each key, with whether there were more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap + 1).withColumn("truncated", F.max("_rn").over(Window.partitionBy(*keys)) > cap).where(F.col("_rn") <= cap).drop("_rn")


def fits(rows: DataFrame, key: str, order: list[str], size: str, count: int, budget: int) -> DataFrame:
    """Rows of each key taken in order as far as they fit: one too large is skipped, not the end. At most ``count`` rows are looked at, so the fold is short."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count)
    packed = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(size).cast("bigint").alias("s")))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        ok = acc["sum"] + x["s"] <= budget
        return F.struct(F.when(ok, acc["sum"] + x["s"]).otherwise(acc["sum"]).alias("sum"), F.when(ok, F.concat(acc["out"], F.array(x["n"]))).otherwise(acc["out"]).alias("out"))

    taken = packed.select(key, F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("_n"))
    return r.join(taken, [key, "_n"]).drop("_n")


def bounded_projection(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The columns cut to ``limit`` characters together: the first ones give way first, each keeping its end; ``omitted`` counts what is gone."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    out, over = df, sum((size(c) for c in columns), F.lit(0)) - limit
    out = out.withColumn("omitted", F.greatest(F.lit(0), over))
    left = F.col("omitted")
    cuts = []
    for c in columns:
        cut = F.least(left, size(c))
        cuts.append((c, cut))
        left = left - cut
    return out.withColumns({c: F.when(cut > 0, F.right(F.col(c), size(c) - cut)).otherwise(F.col(c)) for c, cut in cuts})


def rendered(turns: DataFrame) -> DataFrame:
    """Turns as text: who said what, and how much was left out before."""
    head = F.when(F.coalesce("omitted_before_chars", F.lit(0)) > 0, F.concat(F.lit("[... "), F.col("omitted_before_chars").cast("string"), F.lit(" characters omitted ...]")))
    say = lambda who, c: F.when(~E.blank(c), F.concat(F.lit(f"**{who}**\n\n"), E.trimmed(c)))
    return turns.withColumn("rendered", F.concat_ws("\n\n", head, say("User", "user_prompt"), say("Assistant", "assistant_response")))


def rollup_units(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """``id, pos, unit``: what a session's rollup says, decisions with their reasons (``id, pos, what, why``) before open items (``id, pos, item``); decisions without a reason say too little."""
    d = decisions.where("what is not null and why is not null").select("id", F.struct(F.lit(0).alias("part"), "pos").alias("pos"), F.concat(F.lit("Decision: "), "what", F.lit("\nWhy: "), "why").alias("unit"))
    p = pending.where("item is not null").select("id", F.struct(F.lit(1).alias("part"), "pos").alias("pos"), F.concat(F.lit("Pending: "), "item").alias("unit"))
    return d.unionByName(p)


def session_evidence(units: DataFrame, components: list[str], limit: int = 800) -> DataFrame:
    """``id, text, omitted``: of each session the units that hold any of the words first, then the others, in order, up to the first that does not fit.

    The text with its mark of what is left out, and the statement of coverage
    that is shown with it, keep within ``limit`` characters. Sessions whose first
    unit does not fit have no row. Shell syntax is to be escaped where the text
    is shown.
    """
    low = F.lower("unit")
    holds = F.lit(False)
    for w in components:
        holds = holds | F.contains(low, F.lit(w))
    w = Window.partitionBy("id").orderBy(~F.col("holds"), "pos")
    u = units.withColumn("holds", holds)
    u = u.withColumn("n", F.row_number().over(w)).withColumn("all", F.count("*").over(Window.partitionBy("id")))
    left = F.col("all") - F.col("n")
    size = F.sum(F.length("unit") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2 + F.when(left > 0, 2 + len(OMITTED_AFTER)).otherwise(0) + F.length(coverage(left)) + 1
    u = u.withColumn("fits", F.min((size <= limit)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("fits")
    g = u.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "unit"))), lambda x: x["unit"]), "\n\n").alias("text"), (F.max("all") - F.max("n")).alias("omitted"))
    return g.select("id", F.when(F.col("omitted") > 0, F.concat("text", F.lit("\n\n" + OMITTED_AFTER))).otherwise(F.col("text")).alias("text"), "omitted")


def coverage(omitted: Column) -> Column:
    """The statement of what evidence covers (a fixed value)."""
    return F.concat(F.lit("Coverage: stored rollup; "), omitted.cast("string"), F.lit(" later evidence units omitted; other session material excluded; relevance unverified."))


def attach_children(sessions: DataFrame, parent: str = "parent_id") -> DataFrame:
    """``id, children``: top sessions with the children attached to them; a child whose parent is not stored stands by itself."""
    s = sessions.select("id", F.col(parent).alias("_p"))
    known = s.select(F.col("id").alias("_p"))
    kids = s.where("_p is not null").join(known, "_p", "left_semi").groupBy("_p").agg(F.sort_array(F.collect_list("id")).alias("children"))
    top = s.join(known.withColumn("_known", F.lit(True)), "_p", "left").where("_p is null or _known is null").select("id")
    return top.join(kids, top["id"] == kids["_p"], "left").select("id", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))

"""Lexical recall: rarity-ranked search over titles and texts, and BM25."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.runtime import cut

#: Words of a question that are not searched for.
FILLERS = ("a", "about", "an", "and", "for", "me", "of", "please", "the", "to")
#: How a session was hit, the stronger the larger.
TIERS = {"title": 12_000, "phrase": 10_000, "rollup": 6_000, "content": 4_500, "body": 3_000}
K1, B = 1.2, 0.75


class Question(NamedTuple):
    """A question: its components without fillers, the tokens searched for (compounds too), and the components as a phrase."""

    components: tuple[str, ...]
    tokens: tuple[str, ...]

    @property
    def phrase(self) -> str:
        return " ".join(self.components)


def question(text: str) -> Question | None:
    """What is searched for; nothing where only fillers are asked."""
    t = unicodedata.normalize("NFKC", text)
    t = regex.sub(r"([\p{Ll}\p{Nd}])(\p{Lu})", r"\1 \2", regex.sub(r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"\1 \2", t)).lower()
    parts = lambda x: regex.findall(E.COMPONENT, x)
    components = tuple(w for w in parts(t) if w not in FILLERS)
    if not components:
        return None
    compounds = (x for x in regex.findall(E.COMPOUND, t) if any(w not in FILLERS for w in parts(x)))
    return Question(components, tuple(dict.fromkeys((*compounds, *components))))


def query_tokens(text: str) -> list[str]:
    """Distinct components of a question without fillers."""
    q = question(text)
    return list(dict.fromkeys(q.components)) if q else []


def postings(docs: DataFrame, doc: str, text) -> DataFrame:
    """The inverted index: ``token, doc, tf, length``; a text is exploded once and counted within its document."""
    t = docs.select(F.col(doc).alias("doc"), E.components(text).alias("t")).where(F.size("t") > 0)
    return (t.select("doc", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("doc", "length", "token").agg(F.count("*").cast("int").alias("tf"))
            .select("token", "doc", "tf", "length"))


def term_counts(docs: DataFrame, keys: list[str], text: Column, q: Question) -> DataFrame:
    """``keys, length, tf, compounds``: of every document with any word its length, how often it holds each component, and which compounds. Texts are taken apart once."""
    tokens = list(dict.fromkeys(q.components))
    compounds = [t for t in q.tokens if t not in tokens]
    none = F.array().cast("array<string>")
    held = none
    if compounds:
        may = F.lit(False)
        for c in compounds:
            may = may | F.contains(F.lower(text), F.lit(c))
        held = F.when(may, F.array_intersect(F.array(*[F.lit(c) for c in compounds]), E.lexical_tokens(text))).otherwise(none)
    # the words are a lambda's argument, so that they are made once whatever is asked of them
    of = F.transform(F.array(E.components(text)), lambda t: F.struct(F.size(t).alias("length"), F.filter(t, lambda x: x.isin(*tokens)).alias("t")))
    t = docs.select(*keys, held.alias("compounds"), F.inline(of)).where("length > 0")
    wanted = F.array(*[F.lit(w) for w in tokens])
    t = t.select(*keys, "length", F.transform(wanted, lambda w: F.size(F.filter("t", lambda x: x == w))).alias("tf"), "compounds")
    return cut(t, "term-counts")


def term_parts(counts: DataFrame, keys: list[str], tokens: int) -> DataFrame:
    """``keys, parts``: for each counted document that holds any token, its BM25 part by each token (k1 1.2, b 0.75, inverse frequency at least 1e-6)."""
    # one row: documents, their mean length, and how many hold each token
    whole = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(tokens)]).alias("df"))
    s = counts.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(whole))
    weight = lambda df: F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
    part = lambda tf, df: weight(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return s.select(*keys, F.zip_with("tf", "df", part).alias("parts"))


def bm25(docs: DataFrame, doc: str, text, query: str, limit: int = 20) -> DataFrame:
    """The best documents for any token of the query by BM25; ties go to the smaller id, a question of fillers finds none."""
    q = question(query)
    if q is None:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    counts = term_counts(docs.select(F.col(doc).alias("doc"), text.alias("text")), ["doc"], F.col("text"), Question(q.components, q.components))
    score = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x)
    return term_parts(counts, ["doc"], len(set(q.components))).select("doc", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def _best(counts: DataFrame, tokens: int) -> DataFrame:
    return term_parts(counts, ["id"], tokens).groupBy("id").agg(F.round(F.max(F.array_max("parts")), 6).alias("bm25"))


def bm25_by_session(turns: DataFrame, query: str) -> DataFrame:
    """``id, bm25``: of each session (``id, text`` in any number of rows) the best score that any of its rows has for any one token."""
    q = question(query)
    if q is None:
        return turns.select("id", F.lit(0.0).alias("bm25")).limit(0)
    return _best(term_counts(turns, ["id"], F.col("text"), Question(q.components, q.components)), len(set(q.components)))


def recall(sessions: DataFrame, contents: DataFrame, query: str, strict: bool = True, limit: int = 5) -> DataFrame:
    """The best sessions for a question: ``id, score, tier, hits``.

    ``sessions`` has ``id, title, prompt, rollup, ended_at``, ``contents`` has
    ``id, text`` in any number of rows. A token's weight is its inverse session
    frequency. A session must reach the weight of the rarest token, absent ones
    included; strict recall needs all components and falls back to any of them
    if nothing is found so. If the best has two tokens, one token is too few for
    others. Equal scores go by tier, among hits in the contents by BM25, then
    the later end, then the smaller id. A question of fillers finds nothing.
    """
    q = question(query)
    if q is None:
        return sessions.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("tier"), F.lit(0).alias("hits")).limit(0)
    tokens = list(q.tokens)
    wanted = F.array(*[F.lit(w) for w in tokens])
    held = lambda c: F.array_intersect(wanted, E.lexical_tokens(c))
    components = list(dict.fromkeys(q.components))
    found = term_counts(contents, ["id"], F.col("text"), q)
    own = F.array_compact(F.array(*[F.when(F.col("tf")[i] > 0, F.lit(w)) for i, w in enumerate(components)]))
    in_text = found.select("id", F.concat("compounds", own).alias("t")).where(F.size("t") > 0).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("t"))).alias("in_text"))
    is_phrase = F.contains(F.array_join(E.components("prompt"), " "), F.lit(q.phrase)) if len(q.components) > 1 else F.lit(False)
    s = (sessions.select("id", "ended_at", held("title").alias("in_title"), held("prompt").alias("in_prompt"), held("rollup").alias("in_rollup"), is_phrase.alias("is_phrase"))
         .join(in_text, "id", "left").withColumn("in_text", F.coalesce("in_text", F.array().cast("array<string>"))))
    s = s.withColumn("hit", F.array_union(F.array_union(F.array_union("in_title", "in_prompt"), "in_rollup"), "in_text"))
    s = cut(s, "matched")
    counts = s.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("hit", w)).alias(f"d{i}") for i, w in enumerate(tokens)])
    s = s.where(F.size("hit") > 0).crossJoin(F.broadcast(counts))
    weights = F.map_from_arrays(wanted, F.array(*[E.idf(F.col("n"), F.col(f"d{i}")) for i in range(len(tokens))]))
    score = F.aggregate(F.transform("hit", lambda w: F.element_at(weights, w)), F.lit(0.0), lambda acc, x: acc + x)
    tier = (F.when(F.size("in_title") > 0, TIERS["title"]).when(F.col("is_phrase"), TIERS["phrase"]).when(F.size("in_rollup") > 0, TIERS["rollup"]).when(F.size("in_text") > 0, TIERS["content"]).otherwise(TIERS["body"]))
    needed = F.array(*[F.lit(w) for w in components])
    s = s.select("id", "ended_at", F.round(score, 6).alias("score"), tier.alias("tier"), F.size("hit").alias("hits"), F.round(F.array_max(F.map_values(weights)), 6).alias("floor"),
                 (F.size(F.array_except(needed, "hit")) == 0).alias("every"), F.arrays_overlap(needed, "hit").alias("any")).where("score >= floor and any")
    s = cut(s.join(_best(found, len(components)), "id", "left"), "hits")
    if strict and not s.where("every").isEmpty():
        s = s.where("every")
    s = s.withColumn("order", F.struct("score", "tier", F.when(F.col("tier") == TIERS["content"], F.coalesce("bm25", F.lit(0.0))).otherwise(0.0).alias("c"), "ended_at", (-F.col("id")).alias("i")))
    best = s.agg(F.max_by("hits", "order").alias("best"))
    return s.crossJoin(F.broadcast(best)).where((F.col("best") < 2) | (F.col("hits") >= 2)).orderBy(F.desc("order")).limit(limit).select("id", "score", "tier", "hits")

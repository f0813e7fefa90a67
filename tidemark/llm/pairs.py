"""Broken prompt and response pairs (problem 1).

Each pair gets at most one defect: ``empty``, ``refusal``, ``copied``,
``language`` or ``truncated``, tested in this order. Language defects compare
the language posteriors of prompt and response by a naive Bayes model over
character trigrams (:mod:`tidemark.llm.langid`), refusals are told by another
over words (:mod:`tidemark.llm.refusals`).

Truncation is a likelihood of the text's end: n-grams of the last five, three
and one words are counted over all responses, at all places and where a sentence
ends; the interpolated likelihood that a text ends on its last words is compared
with that of going on. A text is whole too if, after the words before its last,
most texts stop with that last word: answers in set forms ("commit 3f2a9b1") are
seldom seen within texts, and texts that break off stop at any word. Endings
that say it themselves (open fences, dangling list marks, colons, commas) need
no counts.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import langid, refusals
from tidemark.runtime import cut

#: Nats by which the best language must lead, in prompt and in response.
MARGIN = 3.0
#: Occurrences that the shorter n-gram counts as in the likelihood of a longer one, for the last five, three and one words.
BACKOFF = (2.0, 16.0, 64.0)
#: Most words of a line that counts as ended by its line break alone (items, trailers); longer ones may be pasted in halves.
LINE_WORDS = 7
#: Last words up to which the set of those to be counted is broadcast (about 25 MB); beyond, all are counted.
BROADCAST_WORDS = 1 << 18
#: Most letters and digits of an introduction before a repeated prompt.
INTRODUCTION = 40

#: Texts that only stand in for a missing text.
STAND_INS = frozenset("""undefined
null
none
nil
nan
na
n/a
empty
nothing
blank
missing
void
tbd
todo
object object
not available
no content
no response
no output
no answer
no text
no reply
no result
no message
kein inhalt
keine antwort
keine ausgabe
leer
aucun contenu
aucune réponse
aucune sortie
vide
sin contenido
sin respuesta
sin salida
vacío""".splitlines())

#: A request for a language, and the names of the languages.
_ASKED = {
    "de": re.compile(r"\b(?:german|deutsch\w*|allemande?|alemán|aleman)\b", re.I),
    "en": re.compile(r"\b(?:english|englisch\w*|anglaise?|inglés|ingles)\b", re.I),
    "es": re.compile(r"\b(?:spanish|spanisch\w*|espagnole?|español|espanol|castellano)\b", re.I),
    "fr": re.compile(r"\b(?:french|französisch\w*|française?|francés|frances)\b", re.I),
}
LONGEST_STAND_IN = max(sum(map(str.isalnum, x)) for x in STAND_INS)
_EMOJI = frozenset(("So", "Sk", "Cf", "Mn", "Cs", "Co"))
_EXT = re.compile(r"\.[A-Za-z]{1,8}(?:\.[A-Za-z]{1,6})?$")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{7,}")
_CAMEL = re.compile(r"[a-z]+(?:[A-Z][A-Za-z0-9]*)+(?:\(\))?|[a-z]+\(\)")
_DIGITS = re.compile(r"\d+")
_LIST_MARK = re.compile(r"\s*(?:\d+[.)]|[-*+•]|#+|>+)\s*")
_CLOSERS = "\"'”’»)]}*_`“ "


def visible(text: str | None) -> bool:
    """Whether a text holds a letter or digit."""
    return text is not None and any(map(str.isalnum, text))


def is_empty(text: str | None) -> bool:
    """Null, nothing visible, mere punctuation, or a stand-in for missing text."""
    if not visible(text):
        return True
    if sum(1 for _ in islice(filter(str.isalnum, text), LONGEST_STAND_IN + 1)) > LONGEST_STAND_IN:
        return False  # longer than any of them
    core = "".join(ch if ch.isalnum() or ch in "/'" else " " for ch in text.casefold())
    return " ".join(core.split()) in STAND_INS


def _letters(text: str) -> str:
    return "".join(filter(str.isalnum, text.casefold()))


def _last_letter(text: str) -> str:
    return next((x[-1] for x in map(_letters, reversed(text)) if x), "")


def is_copied(prompt: str, response: str) -> bool:
    """Whether a response is the prompt again, in another form or behind an introduction."""
    if _last_letter(prompt) != _last_letter(response):
        return False
    a, b = _letters(prompt), _letters(response)
    if a == b:
        return True
    return len(a) >= 8 and b.endswith(a) and len(b) - len(a) <= INTRODUCTION


class _Kinds(dict):
    """Tokens reduced to what matters for a sentence's end."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1 << 17:
            self.clear()
        t = token.strip("`*_\"'“”«»()[],;:")
        if "/" in t:
            m = _EXT.search(t)
            kind = "P" + m.group().lower() if m else "P"
        elif _HEX.fullmatch(t):
            kind = "H"
        elif _CAMEL.fullmatch(t):
            kind = "F"
        else:
            kind = _DIGITS.sub("0", t.lower())
        self[token] = kind
        return kind


_KINDS = _Kinds()


def _last_words(tokens: list[str], at: int) -> tuple[str, str]:
    """The five and the three last words of a sentence that ends with token ``at``; ``^`` is its start. Short sentences only have the first form."""
    words: list[str] = []
    k = at
    while k >= 0 and len(words) < 5:
        t = tokens[k]
        if k < at and t[-1] in ".!?" and len(t) > 1 and not t[:-1].isdigit():
            break
        kind = _KINDS[t.rstrip(".!?") if k == at else t]
        words.append("P" if k < at and kind[:2] == "P." else kind)
        k -= 1
    if len(words) < 5:
        words.append("^")
    words.reverse()
    five = " ".join(words)
    return five, " ".join(words[-3:]) if words[0] != "^" else five


def last_words(tokens: list[str], at: int) -> tuple[str, str, str]:
    """The n-grams that end with token ``at``: five, three and one."""
    five, three = _last_words(tokens, at)
    return five, three, "1 " + five.rpartition(" ")[2]


_MASK = (1 << 64) - 1
#: Odd factors of the words of an n-gram from its last, and what tells three words and one from five.
_FACTORS = tuple(0x9E3779B97F4A7C15 ** k & _MASK for k in (1, 3, 5, 7, 9, 11))
_THREE, _ONE = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D
_STOP, _LONG, _BREAKS = 1, 2, 4


def _kind_hash(kind: str) -> int:
    return int.from_bytes(hashlib.blake2b(kind.encode("utf-8", "replace"), digest_size=8).digest(), "little")


_CARET = _kind_hash("^")


def words_hash(words: str) -> int:
    """The hash of last words as :func:`last_words` gives them, as a signed number; two different ones of a corpus meet in one with a chance of about 1 in 10^9."""
    parts = words.split(" ")
    one, caret = parts[0] == "1" and len(parts) == 2, parts[0] == "^"
    parts = parts[1:] if one or caret else parts
    h = sum(_kind_hash(w) * f for w, f in zip(reversed(parts), _FACTORS)) + (_CARET * _FACTORS[len(parts)] if caret else 0)
    h = h + (_ONE if one else _THREE if not caret and len(parts) == 3 else 0) & _MASK
    return h - (1 << 64) if h >> 63 else h


def before_last(text: str) -> int | None:
    """The hash of the last words before the last of a text, within its sentence."""
    tokens = _without_symbols(text).rpartition("\n")[2].split()
    if len(tokens) < 2 or len(tokens[-2]) > 1 and tokens[-2][-1] in ".!?" and not tokens[-2][:-1].isdigit():
        return None
    return words_hash(last_words(tokens, len(tokens) - 2)[0])


def text_hash(text: str) -> int:
    """The hash of a text, blanks and line breaks apart, as a signed number."""
    h = _kind_hash(" ".join(text.split()))
    return h - (1 << 64) if h >> 63 else h


class _Tokens(dict):
    """Numbers of tokens; of each the hashes of its kind at a sentence's end and within one, and its marks."""

    def __init__(self) -> None:
        super().__init__()
        self.at_end: list[int] = []
        self.within: list[int] = []
        self.marks: list[int] = []

    def __missing__(self, t: str) -> int:
        stop = t[-1] in ".!?"
        end, kind = _KINDS[t.rstrip(".!?") if stop else t], _KINDS[t]
        self.at_end.append(_kind_hash(end))
        self.within.append(_kind_hash("P" if kind[:2] == "P." else kind))
        self.marks.append((_STOP | (_LONG if len(t) > 1 else 0) | (_BREAKS if len(t) > 1 and not t[:-1].isdigit() else 0)) if stop else 0)
        n = self[t] = len(self)
        return n


def places_and_ends(texts: list[str | None], known: _Tokens) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of five, three and one last words at all places of some texts, and where a sentence is seen to end: by punctuation, or by a line that more text follows.

    The open end of a text is left out, as it tells neither. ``known`` numbers tokens.
    """
    tokens: list[str] = []
    sizes: list[int] = []
    closes: list[int] = []  # of each line: 0 nothing, 1 its break ends it, 2 the text's open end
    for text in texts:
        if text:
            lines = text.rstrip().split("\n")
            for line in lines:
                words = line.split()
                if words:
                    tokens += words
                    sizes.append(len(words))
                    closes.append(1 if len(words) <= LINE_WORDS else 0)
            if lines[-1].strip():
                closes[-1] = 2
    if not tokens:
        return [np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    at_end, within = (np.array(x, np.uint64)[ids] for x in (known.at_end, known.within))
    marks = np.array(known.marks, np.int8)[ids]
    size, close = np.array(sizes), np.array(closes)
    stop = np.cumsum(size)
    line = np.repeat(stop - size, size)
    at = np.arange(len(ids))
    ends = (marks & _LONG) > 0
    last = stop - 1
    unmarked = (marks[last] & _STOP) == 0
    ends[last[unmarked & (close == 1)]] = True
    valid = np.ones(len(ids), bool)
    valid[last[unmarked & (close == 2)]] = False
    # where the sentence of each place begins
    behind = np.where(marks & _BREAKS, at + 1, 0)
    first = np.maximum(np.maximum.accumulate(np.r_[0, behind[:-1]]), line)
    f = [np.uint64(x) for x in _FACTORS]
    one = at_end * f[0]
    five, three = one.copy(), one.copy()
    for d in range(1, 5):
        before = np.maximum(at - d, 0)
        part = np.where(at - d >= first, within[before] * f[d], np.where(at - d == first - 1, np.uint64(_CARET * _FACTORS[d] & _MASK), np.uint64(0)))
        five += part
        if d < 3:
            three += part
    short = at - first < 4  # fewer than five words: there is one form only
    three = np.where(short, five, three + np.uint64(_THREE))
    return [x[valid].view(np.int64) for x in (five, three, one + np.uint64(_ONE))], ends[valid]


def ends_here(counts: list[tuple[int, int]], anywhere: float) -> bool:
    """Whether ending is likelier than going on after last words with these ``(ends, places)``, for the last five, three and one; ``anywhere`` is the share of ends of all places."""
    p = anywhere
    for (ends, places), k in zip(reversed(counts), reversed(BACKOFF)):
        p = (ends + k * p) / (places + k)
    return p >= 0.5


def _without_symbols(text: str) -> str:
    text = text.rstrip()
    while text and (ord(text[-1]) > 127 and unicodedata.category(text[-1]) in _EMOJI or text[-1].isspace()):
        text = text[:-1]
    return text


def ending(text: str, omitted: bool) -> bool | tuple[str, str, str]:
    """Whether a response broke off; its last words where only the corpus can tell."""
    t = _without_symbols(text)
    lines = t.split("\n")
    last = lines[-1].strip()
    fences = [i for i, x in enumerate(lines) if x.lstrip().startswith("```")]
    if fences:
        closed = len(fences) % 2 == 0
        if fences[-1] == len(lines) - 1:
            if last != "```":
                return True  # a fence that opens and holds nothing
            return not closed and not omitted
        if not closed:
            after = langid.prose("\n".join(lines[fences[-1] + 1:]))
            if not (omitted and after):
                return True
    if _LIST_MARK.fullmatch(last) or last[-1:] in tuple(",:(=[{+&\\–—-"):
        return True
    if last[-1:] == ";":
        return bool(langid.prose(last))  # code ends so
    if last.startswith("|") and last.endswith("|"):
        before = lines[-2].strip() if len(lines) > 1 else ""
        return before.startswith("|") and last.count("|") != before.count("|")
    bare = last.rstrip(_CLOSERS)
    tokens = last.split()
    # a point after a number or path may be part of it, as in "version 0." or "src/main."
    if bare[-1:] in tuple("!?…。") or bare[-1:] == "." and not (_DIGITS.search(tokens[-1]) or "/" in tokens[-1]):
        return False
    if last.startswith("|"):
        return True
    return last_words(tokens, len(tokens) - 1)


COLUMNS = ["memory_id", "prompt", "response", "omitted", "prose", "reply_prose", "opening", "at", "n"]
PREPARED = "memory_id bigint, prompt string, response string, omitted bigint, prose string, reply_prose string, opening string, at bigint, n double"
#: Where the counts of the refusals' background begin among those of the languages.
_BACKGROUND = langid.BUCKETS * len(langid.LANGUAGES)


def _prepared(rows: DataFrame) -> DataFrame:
    """All rows with the prose of both texts and the opening sentence of the response, taken out once; and, in rows without memory_id, the counts of labelled trigrams and of openings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BACKGROUND + refusals.BUCKETS)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                texts = [c.to_pylist() for c in b.columns[1:3]]
                prose = [[langid.labelled_prose(t) for t in side] for side in texts]
                openings = [refusals.opening(t) if t else None for t in texts[1]]
                total[:_BACKGROUND] += langid.seed_counts([*prose[0], *prose[1]]).ravel()
                total[_BACKGROUND:] += refusals.background(openings)
                none = pa.nulls(b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([" ".join([line for line, _ in x]) for x in side], pa.string()) for side in prose), pa.array(openings, pa.string()), none.cast(pa.int64()), none], names=COLUMNS)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.string())
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none, none, none.cast(pa.int64()), none, none, none, pa.array(at), pa.array(total[at])], names=COLUMNS)

    return cut(rows.mapInArrow(run, PREPARED), "prepared")


def _models(prepared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The language model of all pairs, in two rounds of trigram counts, and the refusal model."""

    def collected(counts: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for at, n in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most a row per bucket and class
            out[at] = n
        return out

    first = collected(prepared.where("memory_id is null").select("at", "n"), _BACKGROUND + refusals.BUCKETS)
    known = prepared.sparkSession.sparkContext.broadcast(langid.likelihoods(first[:_BACKGROUND].reshape(langid.BUCKETS, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((langid.BUCKETS, len(langid.LANGUAGES)))
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                total += langid.pair_counts(known.value, list(zip(*(c.to_pylist() for c in batch.slice(k, 2000).columns))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    second = collected(prepared.where("memory_id is not null").select("prose", "reply_prose").mapInArrow(run, "at bigint, n double"), _BACKGROUND)
    return langid.likelihoods(second.reshape(langid.BUCKETS, -1)), refusals.fit(first[_BACKGROUND:])


def language_model(rows: DataFrame) -> np.ndarray:
    """The language model of all pairs of a table."""
    return _models(_prepared(rows.select("memory_id", "user_prompt", "assistant_response", F.lit(0).cast("bigint"))))[0]


def _classify(language: np.ndarray, refusal: np.ndarray, prompts: list, responses: list, omitted: list, prose: list, reply_prose: list, openings: list) -> Iterator[tuple]:
    """Row number, defect, and the last five, three and one words, of the pairs of a batch that may be defective."""
    undecided = []
    for i, (u, a) in enumerate(zip(prompts, responses)):
        if not visible(u):
            continue
        if is_empty(a):
            yield i, "empty", None, None, None
        elif refusals.is_refusal(refusal, a, openings[i]):
            yield i, "refusal", None, None, None
        elif is_copied(u, a):
            yield i, "copied", None, None, None
        else:
            undecided.append(i)
    of = [langid.posteriors(language, [side[i] for i in undecided]) for side in (prose, reply_prose)]
    ranked = [np.sort(x, axis=1) for x in of]
    sure = (ranked[0][:, -1] - ranked[0][:, -2] >= MARGIN) & (ranked[1][:, -1] - ranked[1][:, -2] >= MARGIN)
    lu, la = (x.argmax(axis=1) for x in of)
    for n, i in enumerate(undecided):
        if sure[n] and lu[n] != la[n] and not _ASKED[langid.LANGUAGES[la[n]]].search(prompts[i]):
            yield i, "language", None, None, None
            continue
        end = ending(responses[i], bool(omitted[i]))
        if end is True:
            yield i, "truncated", None, None, None
        elif end:
            yield i, None, *end


def find_defects(turns: DataFrame) -> DataFrame:
    """``memory_id, defect`` of the pairs whose response does not serve the prompt.

    A pair is a row whose prompt holds a letter or digit; rows without memory_id
    are left out. Null and blank responses are ``empty``. Repeated rows of one
    memory_id count once; if stored versions differ, the defect of the largest
    name counts. Extra columns are ignored, an empty table gives no rows.
    Null omitted_before_chars count as 0.
    """
    sc = turns.sparkSession.sparkContext
    prepared = _prepared(turns.where("memory_id is not null").select("memory_id", "user_prompt", "assistant_response", F.coalesce("omitted_before_chars", F.lit(0)).cast("bigint").alias("omitted")))
    models = sc.broadcast(_models(prepared))
    names = ["memory_id", "defect", "five", "three", "one", "before", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                ids, *columns = (c.to_pylist() for c in batch.slice(k, 2000).columns)
                found = list(zip(*_classify(*models.value, *columns))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found[0]], pa.int64()), pa.array(list(found[1]), pa.string()), *(pa.array([x and words_hash(x) for x in found[j]], pa.int64()) for j in (2, 3, 4)), *(pa.array([None if d else of(columns[1][i]) for i, d in zip(*found[:2])], pa.int64()) for of in (before_last, text_hash))], names=names)

    rows = prepared.where("memory_id is not null")
    out = cut(rows.select(*COLUMNS[:7]).mapInArrow(run, "memory_id bigint, defect string, five bigint, three bigint, one bigint, before bigint, text bigint"), "pairs")
    open_ = out.where("defect is null").select("memory_id", "five", "three", "one", "before").distinct()
    asked = cut(open_.select(F.explode(F.array("five", "three", "one", "before")).alias("words")).where("words is not null").distinct(), "last-words")
    # how many other texts stop so; a text that is repeated tells nothing new
    stops = out.where("defect is null and before is not null").groupBy("before", "five").agg((F.countDistinct("text") - 1).alias("others"))
    few = asked.limit(BROADCAST_WORDS + 1).collect()
    wanted = np.sort(np.array([r["words"] for r in few], np.int64)) if len(few) <= BROADCAST_WORDS else None
    shared = sc.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        total = None if keys is None else np.zeros((2, len(keys)), np.int64)
        anywhere = np.zeros(2, np.int64)
        known = _Tokens()

        def result(words: np.ndarray, places: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(places, pa.int64()), pa.array(ends, pa.int64())], names=["words", "places", "ends"])

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                grams, ends = places_and_ends(batch.column(0).slice(k, 2000).to_pylist(), known)
                anywhere += len(ends), ends.sum()
                same = grams[0] == grams[1]
                each = np.concatenate([grams[0], grams[1][~same], grams[2]])
                ended = np.concatenate([ends, ends[~same], ends])
                if total is None:
                    own, of = np.unique(each, return_inverse=True)
                    yield result(own, np.bincount(of), np.bincount(of[ended], minlength=len(own)))
                elif len(keys):
                    at = np.minimum(np.searchsorted(keys, each), len(keys) - 1)
                    hit = keys[at] == each
                    total[0] += np.bincount(at[hit], minlength=len(keys))
                    total[1] += np.bincount(at[hit & ended], minlength=len(keys))
                if len(known) > 1 << 18:
                    known = _Tokens()
        if total is not None:
            seen = np.flatnonzero(total[0])
            yield result(keys[seen], total[0][seen], total[1][seen])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array(anywhere[:1]), pa.array(anywhere[1:])], names=["words", "places", "ends"])

    counted = rows.select("response").mapInArrow(count, "words bigint, places bigint, ends bigint").groupBy("words").agg(F.sum("places").alias("places"), F.sum("ends").alias("ends"))
    # null stands for all places together
    counted = cut(counted.join(asked.withColumn("asked", F.lit(True)), "words", "left").where("words is null or asked").drop("asked"), "ends")
    known = counted.where("words is not null")
    all_ = counted.where("words is null").first()
    p = F.lit(all_["ends"] / max(all_["places"], 1) if all_ else 0.0)
    scored = open_
    for n, k in zip(("one", "three", "five"), reversed(BACKOFF)):
        scored = scored.join(known.select(F.col("words").alias(n), F.col("places").alias(f"{n}_places"), F.col("ends").alias(f"{n}_ends")), n, "left")
        p = (F.coalesce(f"{n}_ends", F.lit(0)) + k * p) / (F.coalesce(f"{n}_places", F.lit(0)) + k)
    scored = scored.join(known.select(F.col("words").alias("before"), F.col("places").alias("before_places")), "before", "left").join(stops, ["before", "five"], "left")
    seldom = F.coalesce("others", F.lit(0)) / (F.coalesce("before_places", F.lit(0)) + BACKOFF[0]) < 0.5
    broken = scored.where((p < 0.5) & seldom).select("memory_id", F.lit("truncated").alias("defect"))
    return out.where("defect is not null").select("memory_id", "defect").unionByName(broken).groupBy("memory_id").agg(F.max("defect").alias("defect"))

"""Subject areas of documents by interpolated n-gram language models (problem 8).

Every subject has an interpolated bigram model of the sentences that deal with
it and a background model of all other sentences, both counted over all
documents in Spark. A sentence's score for a subject is the difference of its
cross-entropies per token under the two. Whether it deals with the subject or
only mentions a word in passing is said by another pair of interpolated models,
in which every subject word is replaced by one mark: sentences that deal with
any subject against all others (talk about code, tests and commits, lists, logs,
passing mentions). A document has the subjects of the sentences that deal with
one and whose score reaches that subject's threshold, which is calibrated on the
labelled documents, with these documents' own counts taken out.

Which sentences count for which subject is said by seed models, fitted on a
bounded sample of labelled documents. Labels are known per document, not per
sentence: words that keep to documents of one subject give the first models,
whose sentences train the next ones; a sentence that speaks of a subject its
document is not labelled with is a passing mention.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the models are fitted on, those with the smallest hashed ids.
LABELLED = 8_000
#: Rounds in which sentences are assigned anew.
ROUNDS = 5
#: Weights of bigram, unigram and uniform probabilities.
WEIGHTS = (0.5, 0.48, 0.02)
#: Nats by which a word must prefer a subject to count as a subject word, and a sentence to train its model.
SUBJECT_WORD = 2.0
#: Occurrences added to each word, spread as all words are.
PSEUDO = 2.0
SUBJECT_SENTENCE = 4.0
#: A word seen this often in labelled documents must be preferred by their labels by so many nats.
OFTEN = 6
WITH_LABELS = 0.8
#: Buckets of words and of word pairs in the subject models, and how many classes they may have: at most
#: 4 * (2 * WORDS + PAIRS) bytes for each subject are sent to the driver and broadcast, 4 MB; the counts of all documents fit whatever their number.
WORDS, PAIRS = 1 << 18, 1 << 19
#: Weight of the bigram in a subject model, occurrences that its unigram counts as there, and share of all words in a subject's unigrams.
BIGRAM, BACKOFF, SMOOTHING = 0.5, 20.0, 0.0125
#: Threshold of a subject without labelled documents, in nats a token.
UNLABELLED_LEAST = 1.0
#: Nats a token by which sentences may seem not to deal with a subject in the first rounds and still train its model.
SLACK = 0.7
#: Tokens of which a sentence must have this many to be scored.
LEAST_TOKENS = 3

_BREAK = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|\n+|\r+|\",\s*\"|\[\"|\"\]|\{\"|\":\s*\"")
_MARK = re.compile(r"^\s*(?:[-*+•>#]+|\d+[.)]|\[?\w{1,12}\]?:)\s+")
_EXT = re.compile(r"\w")
_DIGITS = re.compile(r"\d")


def _hash(token: str) -> int:
    """A stable 62-bit hash."""
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8", "replace"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h >> 2


class _Kinds(dict):
    """Hashes of tokens; paths, identifiers, hashes and numbers are reduced to their kind."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        t = token.strip("`*_\"'“”«»()[]{},;:.!?…<>|=").casefold()
        if not _EXT.search(t):
            kind = ""
        elif "/" in t:
            kind = "<path>"
        elif token.strip("`*_\"'()[],;:.!?").removesuffix("()") != t and re.search(r"[a-z][A-Z]", token):
            kind = "<name>"
        elif _DIGITS.search(t):
            kind = "<hash>" if re.fullmatch(r"[0-9a-f]{6,}", t) else "<number>"
        else:
            kind = t
        h = self[token] = _hash(kind) if kind else 0
        return h


_KINDS = _Kinds()
_START = _hash("<s>")


def sentences(text: str) -> list[list[int]]:
    """Hashed tokens of each sentence, item or line of a text."""
    out = []
    for part in _BREAK.split(text):
        if part:
            while m := _MARK.match(part):
                part = part[m.end():]
            tokens = [h for h in map(_KINDS.__getitem__, part.split()) if h]
            if len(tokens) >= LEAST_TOKENS:
                out.append(tokens)
    return out


class Corpus(NamedTuple):
    """Sentences of documents as arrays: unigram and bigram hashes, first token of each sentence, document of each sentence."""

    uni: np.ndarray
    bi: np.ndarray
    begin: np.ndarray
    doc: np.ndarray


def corpus(texts: list[str | None]) -> Corpus:
    tokens: list[int] = []
    begin, doc = [], []
    for i, t in enumerate(texts):
        if t:
            for s in sentences(t):
                begin.append(len(tokens))
                doc.append(i)
                tokens += s
    uni = np.array(tokens, np.uint64)
    before = np.r_[np.uint64(_START), uni[:-1]] if len(uni) else uni
    start = np.array(begin, np.int64)
    if len(uni):
        before[start] = _START
    return Corpus(uni, before * np.uint64(0x9E3779B97F4A7C15) ^ uni, start, np.array(doc, np.int64))


def _index(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return np.where(keys[at] == values, at, -1) if len(keys) else np.full(len(values), -1)


class Ngrams(NamedTuple):
    """Interpolated bigram models over one vocabulary, a column each."""

    uni_keys: np.ndarray
    uni: np.ndarray
    bi_keys: np.ndarray
    bi: np.ndarray

    @classmethod
    def count(cls, c: Corpus, weight: np.ndarray) -> Ngrams:
        """Models of sentences with their weights in each (sentence by model)."""
        sentence = np.repeat(np.arange(len(c.begin)), np.diff(np.r_[c.begin, len(c.uni)]))
        k = weight.shape[1]
        uni_keys, u = np.unique(c.uni, return_inverse=True)
        bi_keys, b = np.unique(c.bi, return_inverse=True)
        uni = np.stack([np.bincount(u, weight[sentence, j], len(uni_keys)) for j in range(k)], 1)
        bi = np.stack([np.bincount(b, weight[sentence, j], len(bi_keys)) for j in range(k)], 1)
        before = np.zeros(len(c.uni), np.int64)
        before[1:] = u[:-1] + 1
        before[c.begin] = 0
        context = np.stack([np.bincount(before, weight[sentence, j], len(uni_keys) + 1) for j in range(k)], 1)
        first = np.zeros(len(bi_keys), np.int64)
        first[b] = before
        # a context seen seldom in a model says little there: it is discounted by two counts
        bi = WEIGHTS[0] * bi / (context[first] + 2.0)
        uni = WEIGHTS[1] * uni / np.maximum(uni.sum(axis=0), 1.0)
        return cls(uni_keys, uni.astype(np.float32), bi_keys, bi.astype(np.float32))

    def log_probabilities(self, c: Corpus) -> np.ndarray:
        """Per token and model (minus the cross-entropy of the token)."""
        u, b = _index(self.uni_keys, c.uni), _index(self.bi_keys, c.bi)
        floor = WEIGHTS[2] / (len(self.uni_keys) + 1)
        return np.log(np.where((u >= 0)[:, None], self.uni[u], 0) + np.where((b >= 0)[:, None], self.bi[b], 0) + floor)


def _against(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log ratio of each column's relative frequency to that of all other columns; ``PSEUDO`` occurrences are as everywhere."""
    share = totals / totals.sum()
    rest = counts.sum(axis=1, keepdims=True) - counts
    return np.log((counts + PSEUDO * share) / share) - np.log((rest + PSEUDO * (1 - share)) / (1 - share))


class Topics(NamedTuple):
    """Per word and per word pair, the nats by which each subject's model prefers it to the background of all else."""

    uni_keys: np.ndarray
    uni: np.ndarray
    bi_keys: np.ndarray
    bi: np.ndarray

    @classmethod
    def count(cls, c: Corpus, weight: np.ndarray) -> Topics:
        """From sentences with their weights in each subject and, last, in none."""
        size = np.diff(np.r_[c.begin, len(c.uni)])
        sentence = np.repeat(np.arange(len(c.begin)), size)
        totals = np.maximum((weight * size[:, None]).sum(axis=0), 1.0)
        out = []
        for values in (c.uni, c.bi):
            keys, i = np.unique(values, return_inverse=True)
            counts = np.stack([np.bincount(i, weight[sentence, j], len(keys)) for j in range(weight.shape[1])], 1)
            out += [keys, _against(counts, totals)[:, :-1].astype(np.float32)]
        return cls(*out)

    def bounded(self, first: Topics, seen: np.ndarray) -> Topics:
        """Without the preferences that the labels of the documents speak against.

        ``first`` are the preferences by document labels alone, ``seen`` how
        often each word occurs in labelled documents. A word that is seen often
        and all over cannot become a subject word by sentences labelled here.
        """
        against = (seen >= OFTEN)[:, None] & (first.uni < WITH_LABELS)
        return self._replace(uni=np.where(against, np.minimum(self.uni, 0), self.uni))

    def words(self) -> np.ndarray:
        """The subject words."""
        return self.uni_keys[self.uni.max(axis=1) >= SUBJECT_WORD]

    def sentence_gains(self, c: Corpus) -> np.ndarray:
        """Per sentence and subject, the interpolated preference of its subject words."""
        u, b = _index(self.uni_keys, c.uni), _index(self.bi_keys, c.bi)
        own = np.where((u >= 0)[:, None], self.uni[u], 0)
        pair = np.where((b >= 0)[:, None], self.bi[b], own)
        gain = np.where(own.max(axis=1, keepdims=True) >= SUBJECT_WORD, 0.5 * own + 0.5 * pair, 0)
        return np.add.reduceat(gain, c.begin, axis=0)


_SUBJECT = _hash("<subject>")


def _masked(c: Corpus, words: np.ndarray) -> Corpus:
    """The corpus with every subject word replaced by one mark."""
    uni = np.where(_index(words, c.uni) >= 0, np.uint64(_SUBJECT), c.uni)
    before = np.r_[np.uint64(_START), uni[:-1]] if len(uni) else uni
    if len(uni):
        before[c.begin] = _START
    return Corpus(uni, before * np.uint64(0x9E3779B97F4A7C15) ^ uni, c.begin, c.doc)


class Seeds(NamedTuple):
    """What the labelled documents teach: preferences and subject words, and the models of dealing and not dealing."""

    subjects: tuple[str, ...]
    topic: Topics
    words: np.ndarray
    manner: Ngrams

    def deals(self, c: Corpus, slack: float = 0.0) -> np.ndarray:
        """Whether each sentence deals with some subject, within ``slack`` nats a token."""
        y = self.manner.log_probabilities(_masked(c, self.words))
        return np.add.reduceat(y[:, 0] - y[:, 1] + slack, c.begin) > 0

    def classes(self, c: Corpus) -> np.ndarray:
        """The subject each sentence clearly deals with, or the number of subjects for none."""
        k = len(self.subjects)
        if not len(c.begin) or not len(self.words):
            return np.full(len(c.begin), k)
        gain = self.topic.sentence_gains(c)
        best = gain.argmax(axis=1)
        return np.where(self.deals(c) & (gain[np.arange(len(gain)), best] >= SUBJECT_SENTENCE), best, k)


def fit(subjects: list[str], labelled: list[tuple[str | None, frozenset[str]]]) -> Seeds:
    """Fit the seed models; ``labelled`` are texts with all their subjects."""
    names = tuple(sorted(subjects))
    k = len(names)
    c = corpus([t for t, _ in labelled])
    if not len(c.begin) or not k:
        keys, none = np.zeros(0, np.uint64), np.zeros((0, 2), np.float32)
        return Seeds(names, Topics(keys, np.zeros((0, k), np.float32), keys, np.zeros((0, k), np.float32)), keys, Ngrams(keys, none, keys, none))
    label = np.array([[float(s in x) for s in names] for _, x in labelled])[c.doc]
    only = np.where(label.sum(axis=1) == 1, label.argmax(axis=1), -1)
    own = (label / np.maximum(label.sum(axis=1, keepdims=True), 1)) ** 2  # documents of several subjects say less about each
    first = Topics.count(c, np.hstack([own, np.zeros((len(own), 1))]))
    seen = np.bincount(_index(first.uni_keys, c.uni), minlength=len(first.uni_keys))
    models = Seeds(names, first, np.zeros(0, np.uint64), None)
    rows = np.arange(len(own))
    for n in range(ROUNDS):
        gain = models.topic.sentence_gains(c)
        best = gain.argmax(axis=1)
        most = gain[rows, best]
        # first only some sentences of the rarer languages are known to deal with anything
        deals = models.deals(c, SLACK / n) if n else np.zeros(len(rows), bool)
        # a clear sentence on one of the document's subjects, or any sentence that deals with something if there is one subject only
        agrees = (most >= SUBJECT_SENTENCE) & (label[rows, best] > 0)
        fills = ~agrees & deals & (only >= 0) & (most < SUBJECT_SENTENCE)
        # without subject words, or on a subject that the document is not labelled with: talk, or a passing mention
        none = ~deals & ~agrees & ((most == 0) | (label[rows, best] == 0))
        own = np.zeros((len(rows), k + 1))
        own[rows[agrees], best[agrees]] = 1
        own[rows[fills], only[fills]] = 1
        own[none, k] = 1
        topic = Topics.count(c, own).bounded(first, seen)
        words = topic.words()
        manner = Ngrams.count(_masked(c, words), np.stack([agrees | fills, none], 1).astype(float))
        models = Seeds(names, topic, words, manner)
    return models


class Counts(NamedTuple):
    """Words, word pairs and what stands before a word, by bucket, in the sentences of each subject and, last, of none."""

    uni: np.ndarray
    bi: np.ndarray
    before: np.ndarray

    @classmethod
    def none(cls, classes: int) -> Counts:
        return cls(*(np.zeros((n, classes), np.float32) for n in (WORDS, PAIRS, WORDS)))

    def add(self, c: Corpus, of: np.ndarray) -> None:
        """Count sentences by their class."""
        if len(c.begin):
            each = np.repeat(of, np.diff(np.r_[c.begin, len(c.uni)]))
            for table, at in zip(self, _buckets(c)):
                table += np.bincount(at * table.shape[1] + each, minlength=table.size).reshape(table.shape)

    def minus(self, other: Counts) -> Counts:
        return Counts(*(np.maximum(a - b, 0) for a, b in zip(self, other)))


def _buckets(c: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its bucket, that of the pair it ends, and that of the token before it."""
    uni = (c.uni % np.uint64(WORDS)).astype(np.int64)
    before = np.r_[0, uni[:-1]]
    before[c.begin] = _START % WORDS
    return uni, ((c.bi ^ (c.bi >> np.uint64(31))) % np.uint64(PAIRS)).astype(np.int64), before


class Models(NamedTuple):
    """Interpolated models of the subjects and of their backgrounds, the seeds, and each subject's threshold in nats a token."""

    seeds: Seeds
    own: np.ndarray
    rest: np.ndarray
    bi: np.ndarray
    before: np.ndarray
    least: np.ndarray

    @property
    def subjects(self) -> tuple[str, ...]:
        return self.seeds.subjects

    @classmethod
    def of(cls, seeds: Seeds, counts: Counts) -> Models:
        """Unigrams are interpolated with all words, so that what neither model has seen tells nothing."""
        uni = counts.uni.astype(np.float64)
        all_ = uni.sum(axis=1, keepdims=True)
        anywhere = (all_ + 0.5) / (all_.sum() + 0.5 * WORDS)
        share = lambda x: ((1 - SMOOTHING) * x / np.maximum(x.sum(axis=0), 1) + SMOOTHING * anywhere).astype(np.float32)
        return cls(seeds, share(uni[:, :-1]), share(all_ - uni[:, :-1]), counts.bi, counts.before, np.full(len(seeds.subjects), UNLABELLED_LEAST))

    def sentence_scores(self, c: Corpus) -> np.ndarray:
        """Per sentence and subject, how much less the cross-entropy per token is under the subject's model than under its background."""
        uni, bi, before = _buckets(c)

        def model(unigram: np.ndarray, pairs: np.ndarray, context: np.ndarray) -> np.ndarray:
            return np.log((1 - BIGRAM) * unigram + BIGRAM * (pairs + BACKOFF * unigram) / (context + BACKOFF))

        pairs, context = self.bi[bi], self.before[before]
        own = model(self.own[uni], pairs[:, :-1], context[:, :-1])
        rest = model(self.rest[uni], pairs.sum(axis=1, keepdims=True) - pairs[:, :-1], context.sum(axis=1, keepdims=True) - context[:, :-1])
        return np.add.reduceat(own - rest, c.begin, axis=0) / np.diff(np.r_[c.begin, len(c.uni)])[:, None]

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        """Per document and subject, the largest score of a sentence that deals with its best subject; -inf without one."""
        c = corpus(texts)
        out = np.full((len(texts), len(self.subjects)), -np.inf)
        if len(c.begin) and len(self.seeds.words):
            rows = np.flatnonzero(self.seeds.deals(c))
            scores = self.sentence_scores(c)[rows]
            best = scores.argmax(axis=1)
            np.maximum.at(out, (c.doc[rows], best), scores[np.arange(len(rows)), best])
        return out

    def calibrated(self, labelled: list[tuple[str | None, frozenset[str]]]) -> Models:
        """With the threshold of each subject that gives its best F1 on labelled documents, the middle of those that do."""
        scores = self.document_scores([t for t, _ in labelled])
        least = self.least.copy()
        for j, name in enumerate(self.subjects):
            truth = np.array([name in x for _, x in labelled], bool)
            found = np.isfinite(scores[:, j])
            if not (truth & found).any():
                continue
            order = np.argsort(-scores[found, j], kind="stable")
            x, hit = scores[found, j][order], np.cumsum(truth[found][order])
            f1 = 2 * hit / (np.arange(1, len(x) + 1) + truth.sum())
            last = np.r_[x[1:] != x[:-1], True]  # equal scores are accepted together
            f1 = np.where(last, f1, 0)
            best = np.flatnonzero(f1 >= f1.max() - 1e-12)
            at = best[len(best) // 2]
            least[j] = (x[at] + x[at + 1]) / 2 if at + 1 < len(x) else x[at] - 0.1
        return self._replace(least=least)


def train(subjects: list[str], labelled: list[tuple[str | None, frozenset[str]]], texts: list[str | None]) -> Models:
    """Models of some texts, counted here; what :func:`learn` does with a table."""
    seeds = fit(subjects, labelled)
    return _finished(seeds, _counted(seeds, texts), labelled)


def _counted(seeds: Seeds, texts: list[str | None]) -> Counts:
    counts = Counts.none(len(seeds.subjects) + 1)
    for k in range(0, len(texts), 1000):
        c = corpus(texts[k:k + 1000])
        counts.add(c, seeds.classes(c))
    return counts


def _finished(seeds: Seeds, counts: Counts, labelled: list[tuple[str | None, frozenset[str]]]) -> Models:
    """Thresholds come from models without the labelled documents' own counts."""
    apart = Models.of(seeds, counts.minus(_counted(seeds, [t for t, _ in labelled]))).calibrated(labelled)
    return Models.of(seeds, counts)._replace(least=apart.least)


def _sample(docs: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """n rows with the smallest hashed ids, found without sorting all rows."""
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    part = min(1.0, 4.0 * n / max(total, 1))
    return docs.where(h <= F.lit(int(part * (1 << 30)))).orderBy(h, "doc_id").limit(n)


def count_documents(docs: DataFrame, seeds: Seeds) -> Counts:
    """The n-grams of all documents (``text``) by class, partial sums of every task summed up; a row per bucket and class at most."""
    classes = len(seeds.subjects) + 1
    shared = docs.sparkSession.sparkContext.broadcast(seeds)
    size = np.cumsum([0, *(classes * n for n in (WORDS, PAIRS, WORDS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.none(classes)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                c = corpus(batch.column(0).slice(k, 1000).to_pylist())
                counts.add(c, shared.value.classes(c))
        for begin, table in zip(size, counts):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at + begin), pa.array(table.ravel()[at].astype(np.float64))], names=["at", "n"])

    flat = np.zeros(size[-1], np.float32)
    sums = docs.select("text").mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return Counts(*(flat[a:b].reshape(-1, classes) for a, b in zip(size, size[1:])))


def learn(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Models:
    """Models counted over all documents, by seeds from a bounded sample of the labelled ones (``LABELLED``, those with the smallest hashed ids).

    Repeated labels count once; labels without document, subjects that are not
    in ``areas``, and nulls are ignored.
    """
    areas = areas.where("subject is not null").select("subject").distinct()
    subjects = [r["subject"] for r in areas.collect()]  # a small fixed table
    known = labels.where("doc_id is not null").join(F.broadcast(areas), "subject").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    sample = _sample(known, LABELLED, known.count(), 5).join(docs, "doc_id").collect()
    labelled = [(r["text"], frozenset(r["subjects"])) for r in sorted(sample, key=lambda r: (r["doc_id"], r["text"]))]
    seeds = fit(subjects, labelled)
    return _finished(seeds, count_documents(docs, seeds), labelled)


def assign(documents: DataFrame, models: Models) -> DataFrame:
    """``doc_id, subject, score`` of every subject a document is about.

    Null, empty and blank texts and texts without sentences have none; rows
    without doc_id are left out; repeated rows each give their subjects; extra
    columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                scores = m.document_scores(part.column(1).to_pylist())
                doc, subject = np.nonzero(scores >= m.least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array([m.subjects[j] for j in subject], pa.string()), pa.array(scores[doc, subject].astype(np.float64))], names=["doc_id", "subject", "score"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string, score double")


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """``subject, documents, share``: the corpus by subject; a document counts for each of its subjects, and as ``none`` without any."""
    ids = documents.where("doc_id is not null").select("doc_id").distinct()
    total = F.lit(float(max(ids.count(), 1)))
    each = ids.join(assigned.select("doc_id", "subject").distinct(), "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("none")))
    return each.groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / total)

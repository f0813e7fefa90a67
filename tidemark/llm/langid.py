"""Language posteriors from a naive Bayes model over character trigrams.

The model is trained here: lines are labelled by
the function words they hold, and trigram counts of the labelled lines give the
class likelihoods. Code, identifiers, paths and numbers are left out of both
training and scoring, and so are lines that mostly consist of them.
"""

from __future__ import annotations

import re

import numpy as np

#: Frequent function words by language, the seed labels.
SEEDS = {
    "de": "aber als auf aus bei bis das dass den der die durch ein eine einen für hat ich ist kann mit nach nicht noch nur oder sich sie sind und von vor war warum was wenn wie wird wir wurde zu zum",
    "en": "after and are because been before but can could did does for from has have how into is it not now of on only should than that the their this to was were what when which why with would you",
    "es": "al como con cuando de del donde el en es está esta este la las lo los más muy no para pero por porque que qué se sin sobre solo su también un una y ya",
    "fr": "au aux avec ce cette c'est comme dans de des du elle en est et il je la le les mais ne nous ou où par pas plus pour pourquoi que qui sans ses sont sur un une vous",
}
LANGUAGES = tuple(SEEDS)
BUCKETS = 1 << 16
#: Share of a line's tokens that must be plain words.
PLAIN = 0.5

_FENCED = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", re.S | re.M)
_QUOTED = re.compile(r"[\"“„«»][^\"“”„«»\n]{1,80}[\"”“«»]|`[^`\n]*`")
_WORD = re.compile(r"[(¿¡'’*_>]*([^\W\d_]+(?:['’-][^\W\d_]+)*)[.,;:!?)'’*_…]*")


def _word(token: str) -> str:
    """The token as a lower-case word, or nothing if it is no plain word."""
    m = _WORD.fullmatch(token)
    if not m:
        return ""
    w = m.group(1)
    return w.lower() if w == w.lower() or w == w.capitalize() or "'" in w or "’" in w else ""


class _Words(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        w = self[token] = _word(token)
        return w


_WORDS = _Words()


def prose(text: str | None) -> list[str]:
    """Lines of plain words of a text."""
    return [x for x, _ in labelled_prose(text)]


def labelled_prose(text: str | None) -> list[tuple[str, int | None]]:
    """Lines of plain words of a text, with the language that their function words tell."""
    if not text:
        return []
    if "```" in text:
        text = _FENCED.sub("\n", text)
    out = []
    for line in _QUOTED.sub(" ", text).splitlines():
        tokens = line.split()
        words = [w for w in map(_WORDS.__getitem__, tokens) if w]
        if words and len(words) >= PLAIN * len(tokens):
            x = " ".join(words)
            if "’" in x:
                x = x.replace("’", "'")
                words = x.split(" ")
            out.append((x, seed_label(words)))
    return out


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all lines, and where those of each line begin."""
    c = np.frombuffer("".join(f" {x} " for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    begin = np.cumsum([0] + [len(x) + 2 for x in lines])
    return (h % np.uint32(BUCKETS)).astype(np.int64), begin


def seed_label(words: list[str]) -> int | None:
    """The language whose function words clearly prevail in a line."""
    hits = [k for of in map(_SEED_OF.get, words) if of for k in of]
    if len(hits) < 3:
        return None
    n = [hits.count(k) for k in range(len(LANGUAGES))]
    most, rest = sorted(n)[:-3:-1]
    return n.index(most) if most >= 3 and most >= 2 * rest + 1 else None


#: The languages of each seed word.
_SEED_OF = {w: tuple(k for k, s in enumerate(SEEDS.values()) if w in s.split()) for s in SEEDS.values() for w in s.split()}


def _counts(lines: list[str], labels: list[int | None]) -> np.ndarray:
    """Trigram counts of labelled lines, a row per bucket and a column per language."""
    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    for k in range(len(LANGUAGES)):
        own = [x for x, y in zip(lines, labels) if y == k]
        if own:
            counts[:, k] = np.bincount(_grams(own)[0], minlength=BUCKETS)
    return counts


def likelihoods(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Log likelihoods from summed counts, a row per bucket and a column per language."""
    # the seed words themselves are the least that is known of a language
    counts = counts + _counts([w for s in SEEDS.values() for w in s.split()], [k for k, s in enumerate(SEEDS.values()) for _ in s.split()])
    counts *= counts.sum() / len(LANGUAGES) / counts.sum(axis=0)  # equal weight
    counts += smoothing
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def seed_counts(texts: list[list[tuple[str, int | None]]]) -> np.ndarray:
    """Counts of the lines of labelled prose whose function words tell their language."""
    lines = [x for t in texts for x in t]
    return _counts([x for x, _ in lines], [y for _, y in lines])


def _scored(model: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods of texts of prose by language; their trigrams, the text of each, and which of them lie within one text."""
    out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
    some = np.array([i for i, x in enumerate(texts) if x], np.int64)
    if not len(some):
        none = np.zeros(0, np.int64)
        return out, none, none, np.zeros(0, bool)
    grams, begin = _grams([texts[i] for i in some])
    like = model[grams]
    within = np.ones(len(grams), bool)
    within[begin[1:-1] - 1] = within[begin[1:-1] - 2] = False
    like[~within] = 0
    out[some] = np.add.reduceat(like, begin[:-1], axis=0)
    size = np.diff(begin)
    size[-1] -= 2  # the last trigram begins two before the end
    return out, grams, np.repeat(some, size), within


def pair_counts(first: np.ndarray, pairs: list[tuple[str | None, str | None]], sure: float = 15.0) -> np.ndarray:
    """Counts of a second round, in which a text too short to tell its language also learns from its partner.

    ``pairs`` are texts of prose. Both texts of nearly all pairs are in one
    language. A text that the first model cannot tell takes the label of the
    other text of its pair, so that phrases like "go on" become known.
    """
    flat = [t for pair in pairs for t in pair]
    score, grams, of, within = _scored(first, flat)
    best = score.argmax(axis=1)
    ranked = np.sort(score, axis=1)
    lead = ranked[:, -1] - ranked[:, -2]
    partner = np.arange(len(flat)) ^ 1
    label = np.where(lead >= sure, best, np.where(lead[partner] >= sure, best[partner], -1))[of] if len(of) else of
    return np.stack([np.bincount(grams[within & (label == k)], minlength=BUCKETS) for k in range(len(LANGUAGES))], 1).astype(float)


def fit(texts: list[str]) -> np.ndarray:
    """Log likelihoods, a row per bucket and a column per language."""
    return likelihoods(seed_counts([labelled_prose(t) for t in texts]))


def fit_pairs(pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """Like :func:`fit`, in two rounds."""
    return likelihoods(pair_counts(fit([t for pair in pairs for t in pair if t]), [(plain(a), plain(b)) for a, b in pairs]))


def plain(text: str | None) -> str:
    """The prose of a text in one line."""
    return " ".join(prose(text))


def log_posteriors(model: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Log posteriors (equal priors) of each text; all equal where nothing is known."""
    return posteriors(model, [plain(t) for t in texts])


def posteriors(model: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The same of texts of prose."""
    score = _scored(model, texts)[0]
    score -= score.max(axis=1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

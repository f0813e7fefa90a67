"""Long exact spans shared between records (problem 4).

A paragraph is every window of ``SPAN`` consecutive code points, wherever it
starts, so that a span counts also where it crosses or splits written
paragraphs. Its MinHash is the least hash of its ``GRAM``-grams. Equal windows
have equal minima, so one band of one row finds every shared span; neighbouring
windows mostly share their minimum, so a text needs only about one print per
``(SPAN - GRAM + 2) / 2`` characters. Colliding windows are verified exactly:
the windows that hold the gram are found equal by their hashes, in the tasks
that share the gram, and then compared character by character.

A print that stands for very many windows, in many texts or in one text that
repeats itself, is not compared in one task: its windows are spread by the hash
of the whole window, once for each text and hash, and counted with partial sums.
What a task holds is thus bounded by windows and their characters, not by texts.

Texts linked by shared spans, directly or over others, form clusters
(:func:`clusters`), whose smallest memory_id stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.projects import components
from tidemark.runtime import cut

SPAN = 200
GRAM = 128
#: Code points hashed together.
CHUNK = 1 << 18
#: Windows from which those of a print are spread over tasks; each has 200 characters at most beside its neighbour's.
HOT = 1 << 17
#: Prints up to which they are broadcast (about 24 bytes each in memory), and up to which the texts that hold them are, with their prints
#: (at most 100 bytes a print): 4 and 12 MB. Beyond, the join shuffles.
BROADCAST_PRINTS = 1 << 17
BROADCAST_TEXTS = 1 << 17
#: Rows handed on at once.
ROWS = 4096

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
FIELDS = ("user_prompt", "assistant_response")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(c: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all ``size``-grams; pieces of powers of two are put together."""
    power, block, out, width = _MULT, c.astype(np.uint64) + np.uint64(1), None, 0
    n, left = 1, size
    while True:
        if left & n:
            # out covers width points, block n points
            out = block if out is None else out[:len(out) - n] * np.uint64(power) + block[width:] if len(out) > n else out[:0]
            width += n
        if width == size:
            return _mix(out)
        block = block[:-n] * np.uint64(power) + block[n:] if len(block) > n else block[:0]
        power = power * power & _MASK
        n *= 2


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = 1
    while n * 2 <= width and len(h) > n:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = width - n
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest and len(h) > rest else h if not rest else h[:0]


def prints(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one print: text number, print, first and last start of the run, position of the gram.

    Positions count code points within the text. Texts shorter than ``span`` have none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    keep = np.flatnonzero(sizes >= span)
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(keep):
        end, chars = at, 0
        while end < len(keep) and (end == at or chars + sizes[keep[end]] <= CHUNK):
            chars += sizes[keep[end]]
            end += 1
        group, at = keep[at:end], end
        c = np.frombuffer("".join([texts[i] for i in group]).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = gram_hashes(c, gram)
        m = least_in_windows(h, span - gram + 1)
        begin = np.cumsum(sizes[group]) - sizes[group]
        count = sizes[group] - span + 1
        text = np.repeat(np.arange(len(group)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # of the window in its text
        value = m[start + begin[text]]
        new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
        stop = np.r_[new[1:], len(value)] - 1
        parts.append((group[text[new]], value[new], start[new], start[stop], _first_at(h, value[new], begin[text[new]] + start[new], span - gram + 1) - begin[text[new]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _first_at(h: np.ndarray, value: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """Where in the window of grams its minimum stands first."""
    out = np.empty(len(window), np.int64)
    for k in range(0, len(window), 4096):
        w = window[k:k + 4096]
        out[k:k + 4096] = w + np.argmax(h[w[:, None] + np.arange(width)] == value[k:k + 4096, None], axis=1)
    return out


def text_prints(turns: DataFrame) -> DataFrame:
    """``fp, memory_id, field, n`` for the distinct prints of every text; n windows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for f in (0, 1):
                texts = [t or "" for t in batch.column(1 + f).to_pylist()]
                text, fp, first, last, _ = prints(texts)
                pair, at = np.unique(np.stack([text.astype(np.uint64), fp], 1), axis=0, return_inverse=True) if len(text) else (np.empty((0, 2), np.uint64), np.empty(0, np.int64))
                n = np.bincount(at.ravel(), last - first + 1, len(pair)).astype(np.int64) if len(pair) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)), pa.array(ids[pair[:, 0].astype(np.int64)]), pa.array(np.full(len(pair), f, np.int8)), pa.array(n)], names=["fp", "memory_id", "field", "n"])

    return turns.where("memory_id is not null").select("memory_id", *FIELDS).mapInArrow(run, "fp bigint, memory_id bigint, field tinyint, n bigint")


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts of windows as intervals of text, put together where they touch."""
    new = np.flatnonzero(np.r_[True, np.diff(starts) > SPAN])
    return starts[new], starts[np.r_[new[1:], len(starts)] - 1] + SPAN


def _occurrences(candidates: DataFrame) -> DataFrame:
    """Where the colliding prints of the candidate texts stand.

    A row per run: ``fp, memory_id, field, first, last`` (window starts) and
    ``around``, the text from the first window to the end of the last. For hot
    prints a row per text and window instead, with ``key`` the hash of the window
    and in ``begins, ends`` where it stands.
    """
    schema = "fp bigint, key bigint, memory_id bigint, field tinyint, first int, last int, around string, begins array<int>, ends array<int>"
    names = ["fp", "key", "memory_id", "field", "first", "last", "around", "begins", "ends"]
    arrow = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("memory_id", pa.int64()), ("field", pa.int8()), ("first", pa.int32()), ("last", pa.int32()), ("around", pa.string()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, fields, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        wanted = [{x["fp"]: x["hot"] for x in fps} for fps in batch.column(3).to_pylist()]
        hot: dict[int, list[tuple[int, int]]] = {}
        text, fp, first, last, _ = prints(texts)
        for t, v, a, b in zip(text.tolist(), fp.view(np.int64).tolist(), first.tolist(), last.tolist()):
            is_hot = wanted[t].get(v)
            if is_hot:
                hot.setdefault(t, []).append((a, b))
            elif is_hot is not None:
                yield v, None, ids[t], fields[t], a, b, texts[t][a:b + SPAN], None, None
        for t, runs in hot.items():
            h = gram_hashes(_codes(texts[t]), SPAN).view(np.int64)
            starts = np.concatenate([np.arange(a, b + 1) for a, b in runs])
            order = np.lexsort((starts, h[starts]))
            starts = starts[order]
            edges = np.flatnonzero(np.r_[True, np.diff(h[starts]) != 0])
            for x, y in zip(edges, np.r_[edges[1:], len(starts)]):
                begins, ends = _joined(starts[x:y])
                yield None, int(h[starts[x]]), ids[t], fields[t], None, None, None, begins.tolist(), ends.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                each = rows(batch.slice(k, 256))
                while some := list(islice(each, ROWS)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in some], schema=arrow)

    return candidates.mapInArrow(run, schema)


def _shared_windows(ids: list[int], fields: list[int], first: list[int], around: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """Of the runs of one print: ``memory_id, field, begin, end`` of what another memory_id has too, and the least memory_id that has it."""
    if len(set(ids)) < 2:
        return
    owners: dict[str, tuple[int, int]] = {}  # of each text the least and the greatest memory_id
    for i, s in zip(ids, around):
        lo, hi = owners.get(s, (i, i))
        owners[s] = min(lo, i), max(hi, i)
    texts = list(owners)
    if len(texts) == 1:
        (lo, _), = owners.values()
        yield from ((i, f, a, a + len(s), lo) for i, f, a, s in zip(ids, fields, first, around))
        return
    hashes = [gram_hashes(_codes(s), SPAN) for s in texts]
    size = np.array([len(h) for h in hashes])
    of, start = np.repeat(np.arange(len(texts)), size), np.concatenate([np.arange(n) for n in size])
    lo, hi = (np.array([owners[s][k] for s in texts], np.int64)[of] for k in (0, 1))
    order = np.argsort(h := np.concatenate(hashes), kind="stable")
    new = np.r_[True, np.diff(h[order]) != 0]
    edges, group = np.flatnonzero(new), np.cumsum(new) - 1
    least, most = np.minimum.reduceat(lo[order], edges)[group], np.maximum.reduceat(hi[order], edges)[group]
    shared = np.empty(len(order), bool)
    shared[order] = least != most
    rep = np.empty(len(order), np.int64)
    rep[order] = least
    head = np.empty(len(order), np.int64)  # the first window with this hash
    head[order] = order[edges][group]
    odd = set()
    for w in np.flatnonzero(shared & (head != np.arange(len(head)))):
        k, x, y = int(start[w]), int(of[w]), int(head[w])
        if texts[x][k:k + SPAN] != texts[int(of[y])][int(start[y]):int(start[y]) + SPAN]:
            odd.add(int(h[w]))
    if odd:  # different windows with one hash are told apart by their text
        exact: dict[str, list[int]] = {}
        for w in np.flatnonzero(np.isin(h, np.array(list(odd), h.dtype))):
            exact.setdefault(texts[int(of[w])][int(start[w]):int(start[w]) + SPAN], []).append(int(w))
        for ws in exact.values():
            shared[ws], rep[ws] = min(lo[ws]) != max(hi[ws]), min(lo[ws])
    begin = np.cumsum(size) - size
    found: dict[str, list[tuple[int, int, int]]] = {}
    for x, s in enumerate(texts):
        own = slice(begin[x], begin[x] + size[x])
        at, r = np.flatnonzero(shared[own]), rep[own]
        found[s] = []
        if len(at):
            cuts = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(r[at]) != 0)])
            found[s] = [(int(at[c]), int(at[d - 1]) + SPAN, int(r[at[c]])) for c, d in zip(cuts, np.r_[cuts[1:], len(at)])]
    for i, f, a, s in zip(ids, fields, first, around):
        yield from ((i, f, a + b, a + e, r) for b, e, r in found[s])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by print: what also stands in another memory_id, as intervals."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["memory_id", "field", "begin", "end", "rep"])

    held: list[list] = [[], [], [], []]
    current = None
    for batch in batches:
        fp = batch.column(0).to_numpy()
        cols = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
        edges = np.r_[np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]), len(fp)] if len(fp) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if fp[a] != current:
                each = _shared_windows(*held)
                while some := list(islice(each, ROWS)):
                    yield out(some)
                held, current = [[], [], [], []], fp[a]
            for h, c in zip(held, cols):
                h += c[a:b]
    each = _shared_windows(*held)
    while some := list(islice(each, ROWS)):
        yield out(some)


def shared_intervals(turns: DataFrame) -> DataFrame:
    """``memory_id, field, begin, end, rep``: overlapping intervals of code points that stand verbatim in another memory_id, each of at least ``SPAN``, and the least memory_id that has it."""
    occ = cut(text_prints(turns), "prints")
    shared = cut(occ.groupBy("fp").agg(F.min("memory_id").alias("lo"), F.max("memory_id").alias("hi"), F.sum("n").alias("n"))
                 .where("lo <> hi").select("fp", (F.col("n") > HOT).alias("hot")), "shared-prints")
    wanted = cut(occ.join(_small(shared, shared.count() <= BROADCAST_PRINTS), "fp").groupBy("memory_id").agg(F.collect_set(F.struct("field", "fp", "hot")).alias("all")), "shared-texts")
    carried = wanted.agg(F.sum(F.size("all"))).first()[0] or 0
    texts = (turns.select("memory_id", *FIELDS).join(_small(wanted, carried <= BROADCAST_TEXTS), "memory_id")
             .withColumn("f", F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).alias("text")) for i, c in enumerate(FIELDS)])))
             .select("memory_id", "f.field", "f.text", F.transform(F.filter("all", lambda x: x["field"] == F.col("f.field")), lambda x: F.struct(x["fp"].alias("fp"), x["hot"].alias("hot"))).alias("fps"))
             .where(F.size("fps") > 0).where(F.length("text") >= SPAN))
    at = cut(_occurrences(texts), "occurrences")
    plain = (at.where("key is null").select("fp", "memory_id", "field", "first", "around")
             .repartition("fp").sortWithinPartitions("fp").mapInArrow(_verify, "memory_id bigint, field tinyint, begin int, end int, rep bigint"))
    hot = at.where("key is not null").select("key", "memory_id", "field", "begins", "ends")
    twice = hot.groupBy("key").agg(F.min("memory_id").alias("rep"), F.max("memory_id").alias("hi")).where("rep <> hi").select("key", "rep")
    return plain.unionByName(hot.join(twice, "key").select("memory_id", "field", F.inline(F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end"))), "rep"))


def clusters(turns: DataFrame) -> DataFrame:
    """``memory_id, cluster, texts``: the memories that share spans, directly or over others, by the least memory_id among them, and how many of their texts do."""
    links = cut(shared_intervals(turns).groupBy("memory_id", "field", "rep").agg(F.count("*").alias("n")), "links")
    label = components(links, "memory_id", "rep").withColumnRenamed("component", "cluster")
    return label.join(links.groupBy("memory_id").agg(F.countDistinct("field").alias("texts")), "memory_id").select("memory_id", "cluster", "texts")


def _named(field: str = "field"):
    return F.when(F.col(field) == 0, FIELDS[0]).otherwise(FIELDS[1])


def texts_with_shared_spans(turns: DataFrame) -> DataFrame:
    """``memory_id, field`` of the texts that hold ``SPAN`` consecutive code points which also stand in another memory_id.

    Null, empty and shorter texts have none; rows without memory_id are left
    out; repeated rows of one memory_id, and its own other field, do not count as
    another; extra columns are ignored and an empty table gives no rows.
    """
    return shared_intervals(turns).select("memory_id", "field").distinct().select("memory_id", _named().alias("field"))


def shared_shares(turns: DataFrame) -> DataFrame:
    """``memory_id, field, n_chars, shared_chars, share`` of every text that is not null.

    Of several stored texts of one memory_id and field the longest (then the
    largest) counts. shared_chars counts code points within shared spans once.
    """
    i = F.sort_array(F.collect_set(F.struct("begin", "end")))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum"))
    add = lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["begin"]))).alias("sum"))
    covered = shared_intervals(turns).groupBy("memory_id", "field").agg(F.aggregate(i, start, add, lambda acc: acc["sum"]).alias("shared_chars"))
    sizes = (turns.where("memory_id is not null").select("memory_id", F.posexplode(F.array(*[F.length(c) for c in FIELDS])).alias("field", "n_chars"))
             .where("n_chars is not null").groupBy("memory_id", F.col("field").cast("tinyint").alias("field")).agg(F.max("n_chars").alias("n_chars")))
    return (sizes.join(covered, ["memory_id", "field"], "left")
            .select("memory_id", _named().alias("field"), F.col("n_chars").cast("bigint").alias("n_chars"), F.least("n_chars", F.coalesce("shared_chars", F.lit(0))).cast("bigint").alias("shared_chars"))
            .withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)))

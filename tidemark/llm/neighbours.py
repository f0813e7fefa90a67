"""Most similar vectors for every vector by a permutation index (problem 5).

Every group of comparable vectors, however small, gets pivots, a bounded sample
of its own vectors. A vector is represented by its ``PREFIX`` nearest pivots in
order of similarity and posted in the inverted files of the first ``POSTED`` of
them. Within a posting list each member is a query: the members are ranked by
the footrule distance between the permutations, and only the best ``CANDIDATES``
are multiplied with the query and ranked again by cosine. A query's best over
its lists are merged. Vectors travel as unit vectors in half precision, which
moves a cosine by about 0.00002.

The number of pivots grows with the root of the group, so lists do too. A list
beyond ``LIST`` members is cut into blocks and every block of queries meets
every block of members in a task of its own. ``CANDIDATES`` are taken from each
block, among them those that the uncut list would have, so nothing is lost by
the cut, and no task holds more than two blocks. A query that finds fewer than k
meets its whole group in blocks likewise, by cosine. Equal vectors are
represented by one of them, so copies cost nothing.

Postings are made in passes, each of a hash slice of the tasks and of about
``PASS`` copies of the vectors. The best of the passes so far are merged with
those of the next and the files of a pass go at its end. So the disk holds a few
copies of the vectors, however many lists and blocks a vector is posted in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut, uncut

#: Pivots kept of a vector's permutation. Lists grow with the group, so their ranking needs more than eight: with 8, 2.5 million vectors lose a tenth of their neighbours in it.
PREFIX = 16
#: Posting lists a vector is put in. Neighbours share fewer pivots the more there are.
POSTED = 7
#: Members of a list ranked again by cosine, per query.
CANDIDATES = 96
#: Most members of a posting list, or of a block of one, in a task.
LIST = 16384
#: Pivots of a group, by the root of its size.
PIVOTS_PER_ROOT = 1.25
#: Most pivots of a group. At 1536 dimensions that is 50 MB in single precision.
MAX_PIVOTS = 8192
#: Most bytes of pivots of all groups; beyond, each gets fewer in proportion.
PIVOT_BYTES = 256 << 20
#: Copies of all vectors posted in a pass, about, and bytes up to which there is only one.
PASS, PASS_BYTES = 1, 8 << 20
#: Bytes of a shuffle partition beyond which there are more of them than the session sets.
PARTITION_BYTES = 16 << 20
#: Bytes of candidates multiplied at once.
AT_ONCE = 32 << 20


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Fixed-length binaries as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def unit_vectors(df: DataFrame) -> DataFrame:
    """``session_id, computed_at, model, model_revision, dimensions, v``: v is the unit vector in half precision, null if unusable."""
    schema = "session_id bigint, computed_at timestamp_ntz, model string, model_revision string, dimensions int, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column(4).to_pylist(), batch.column(5)
            sizes = vectors.value_lengths().to_pylist()
            out: list[bytes | None] = [None] * batch.num_rows
            for size in {n for n, d in zip(sizes, dims) if n and n == d}:
                at = [i for i, (n, d) in enumerate(zip(sizes, dims)) if n == d == size]
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                top = np.abs(x).max(axis=1, keepdims=True)
                with np.errstate(all="ignore"):
                    x = x / top  # before the norm, which may overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                fine = np.isfinite(top[:, 0]) & np.isfinite(x).all(axis=1)
                for i, ok, row in zip(at, fine, x.astype(np.float16)):
                    if ok:
                        out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=["session_id", "computed_at", "model", "model_revision", "dimensions", "v"])

    return df.select("session_id", "computed_at", "model", "model_revision", "dimensions", "vector").mapInArrow(run, schema)


def latest_usable(df: DataFrame) -> DataFrame:
    """One row ``id, g, dims, v`` per session whose latest row is usable; g names the group of comparable vectors."""
    last = (unit_vectors(df.where("session_id is not null")).groupBy("session_id")
            .agg(F.max(F.struct("computed_at", "model", "model_revision", "dimensions", "v")).alias("x")))
    return (last.where("x.v is not null")
            .select(F.col("session_id").alias("id"), F.xxhash64("x.model", "x.model_revision", "x.dimensions", F.col("x.model").isNull(), F.col("x.model_revision").isNull()).alias("g"), F.col("x.dimensions").alias("dims"), "x.v"))


def choose_pivots(rows: DataFrame, seed: int = 11) -> dict[int, np.ndarray]:
    """Pivots of every group: the vectors with the smallest hashed ids, a bounded sample."""
    sizes = {r["g"]: (r["n"], r["dims"]) for r in rows.groupBy("g", "dims").agg(F.count("*").alias("n")).collect()}  # a row per model, revision and dimensions
    want = {g: min(MAX_PIVOTS, n, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n))) for g, (n, _) in sizes.items()}
    need = sum(4 * m * sizes[g][1] for g, m in want.items())
    if need > PIVOT_BYTES:
        want = {g: max(1, int(m * PIVOT_BYTES / need)) for g, m in want.items()}
    if not sizes:
        return {}
    spark = rows.sparkSession
    plan = spark.createDataFrame([(g, min(1.0, (3.0 * m + 50) / sizes[g][0]), m) for g, m in want.items()], "g bigint, part double, m int")
    h = F.xxhash64("id", F.lit(seed))
    pool = rows.withColumn("h", h).join(F.broadcast(plan), "g").where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) <= F.col("part"))
    taken = pool.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))).where("rn <= m").select("g", "v").collect()
    out: dict[int, list[bytes]] = {}
    for g, v in taken:
        out.setdefault(g, []).append(bytes(v))
    return {g: np.frombuffer(b"".join(vs), np.float16).reshape(len(vs), -1).astype(np.float32) for g, vs in out.items()}


def permutations(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``p``, the vector's nearest pivots in order."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for g in np.unique(gs):
                part = batch.filter(pa.array(gs == g))
                p = shared.value[int(g)]
                near = _matrix(part.column(3), p.shape[1], np.float16).astype(np.float32) @ p.T
                top = min(PREFIX, p.shape[0])
                first = np.argpartition(-near, top - 1, axis=1)[:, :top]
                order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
                first = np.take_along_axis(first, order, 1).astype(np.int16)
                lists = pa.ListArray.from_arrays(np.arange(0, top * (len(first) + 1), top, dtype=np.int32), first.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "g", "dims", "v", "p"])

    return rows.select("id", "g", "dims", "v").mapInArrow(run, "id bigint, g bigint, dims int, v binary, p array<smallint>")


def _blocks(queries: Column, members: Column, role: str) -> Column:
    """The tasks ``qb, mb`` a row takes part in, if queries and members are cut into so many blocks, and its role there: q, m or both."""
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    part = lambda qb, mb, q, m: F.struct(qb.alias("qb"), mb.alias("mb"), F.lit(q).alias("q"), F.lit(m).alias("m"))
    if role == "q":
        return F.transform(every(members), lambda j: part(own(queries), j, True, False))
    if role == "m":
        return F.transform(every(queries), lambda i: part(i, own(members), False, True))
    rest = F.filter(every(members), lambda j: j != own(members))
    return F.concat(F.array(part(own(members), own(members), True, True)), F.transform(rest, lambda j: part(own(members), j, True, False)), F.transform(rest, lambda i: part(i, own(members), False, True)))


def _bytes(df: DataFrame, rows: Column) -> int:
    """Bytes of so many rows with their vectors."""
    return int(df.agg(F.sum(rows * (2 * F.col("dims") + 64).cast("bigint")).alias("n")).first()["n"] or 0)


def long_lists(perms: DataFrame) -> DataFrame:
    """``g, p1, n, dims, rows``: the lists cut into n > 1 blocks and the rows posted for each."""
    sizes = perms.select("g", "dims", F.explode(F.slice("p", 1, POSTED)).alias("p1")).groupBy("g", "p1").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("n"), F.count("*").alias("members"), F.first("dims").alias("dims"))
    return cut(sizes.where("n > 1").select("g", "p1", "n", "dims", "members", (F.col("members") * (2 * F.col("n") - 1)).alias("rows")), "long-lists", sweep=True)


def posted(perms: DataFrame, long: DataFrame) -> DataFrame:
    """Postings ``g, p1, qb, mb, q, m, id, dims, p, v``: the lists are (g, p1), cut into blocks where they are ``long``, as at most one in ``LIST`` postings is."""
    rows = perms.select("*", F.explode(F.slice("p", 1, POSTED)).alias("p1")).join(F.broadcast(long.select("g", "p1", "n")), ["g", "p1"], "left")
    n = F.coalesce("n", F.lit(1))
    return rows.select("g", "p1", "id", "dims", "p", "v", F.inline(_blocks(n, n, "both")))


def _ranked(k: int, footrule: bool = True):
    """The function of a task: the k nearest members of each query, by footrule first and by the cosine of the best then; or by the cosine of all."""

    def run(table: pa.Table) -> pa.Table:
        ids, asks, answers = table.column("id").to_numpy(), np.flatnonzero(table.column("q").to_numpy()), np.flatnonzero(table.column("m").to_numpy())
        n, dims = len(answers), table.column("dims")[0].as_py()
        v = _matrix(table.column("v").combine_chunks(), dims, np.float16)
        here, y = ids[answers], v[answers].astype(np.float32)
        few = min(n, CANDIDATES + 1) if footrule else n
        take = min(k + 1, few)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if footrule:
            p = table.column("p").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            width = p.shape[1]
            # for each pivot of the list, how near it is to each member: width for the nearest, 0 where it is not among the first
            pivots, at = np.unique(p[answers], return_inverse=True)
            near = np.zeros((len(pivots) + 1, n), np.uint8)
            near[at.reshape(n, width), np.arange(n)[:, None]] = width - np.arange(width)
            of = np.minimum(np.searchsorted(pivots, p[asks]), len(pivots) - 1) if n else np.zeros((len(asks), width), np.int64)
            of = np.where(pivots[of] == p[asks], of, len(pivots)) if n else of
        step = max(8, AT_ONCE // (4 * dims * max(few, 1)))
        for k0 in range(0, len(asks) if n else 0, step):
            q = slice(k0, k0 + step)
            x = v[asks[q]].astype(np.float32)
            if few < n:
                # footrule = width * (width + 1) - 2 * shared
                shared = np.zeros((len(x), n), np.uint8)
                for i in range(width):
                    shared += np.minimum(near[of[q, i]], np.uint8(width - i))
                cand = np.argpartition(shared, n - few, axis=1)[:, n - few:]
                sims = np.matmul(y[cand], x[:, :, None])[:, :, 0]
            else:
                cand = np.broadcast_to(np.arange(n), (len(x), n))
                sims = x @ y.T
            own = ids[asks[q], None]
            sims[here[cand] == own] = -4
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            values = np.take_along_axis(sims, best, 1)
            real = values > -2
            found.append((np.broadcast_to(own, values.shape)[real], here[np.take_along_axis(cand, best, 1)][real], values[real]))
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return pa.table({"a": a, "b": b, "sim": s.astype(np.float32)})

    return run


FOUND = "a bigint, b bigint, sim float"


def _in_passes(best: DataFrame | None, posts: DataFrame, keys: list[str], total: int, size: int, k: int, footrule: bool = True) -> DataFrame:
    """The k best of ``best`` and of the tasks ``keys`` of ``posts``, ``total`` bytes from vectors of ``size`` bytes; ``best`` is removed."""
    passes = max(1, math.ceil(total / max(1, PASS * size, PASS_BYTES)))
    n = math.ceil(2 * total / passes / PARTITION_BYTES)
    for i in range(passes):
        rows = posts.where(F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(passes)) == i)
        if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # partitions that do not grow with the data
            rows = rows.repartition(n, *keys)
        found = rows.groupBy(*keys).applyInArrow(_ranked(k, footrule), FOUND)
        last, best = best, cut(_top(found if best is None else best.select("a", "b", "sim").unionByName(found), k), "neighbours", sweep=True)
        if last is not None:
            uncut(last)
    return best


def _whole(best: DataFrame, rows: DataFrame, short: DataFrame, size: int, k: int) -> DataFrame:
    """``best`` with the queries ``short`` against all ``rows``, of ``size`` bytes, of their groups, a block against a block in each task."""
    count = lambda df, to: df.groupBy("g", "dims").agg(F.count("*").alias(to), F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias(f"n{to}"))
    n = cut(count(short, "q").join(count(rows, "m"), ["g", "dims"]), "short-groups", sweep=True)  # a row per model, revision and dimensions
    both = [df.join(F.broadcast(n.select("g", "nq", "nm")), "g").select("g", "id", "dims", "v", F.inline(_blocks(F.col("nq"), F.col("nm"), role))) for df, role in ((short, "q"), (rows, "m"))]
    total = _bytes(n, F.col("q") * F.col("nm") + F.col("m") * F.col("nq"))
    return _in_passes(best, both[0].unionByName(both[1]), ["g", "qb", "mb"], total, size, k, footrule=False)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each a; the same pair from several lists counts once, ties go to the smaller b."""
    once = found.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= k)


def copies_of(rows: DataFrame) -> DataFrame:
    """``id, rep``: every row of a vector that occurs more than once in its group, and the one that stands for it."""
    keyed = rows.select("id", "g", F.md5("v").alias("h"))
    several = keyed.groupBy("g", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(several, ["g", "h"]).select("id", "rep")


def _with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The k nearest of every row from those of the vectors' representatives; no class is ever paired with itself, k + 1 of its members do."""
    some = cut(copies.withColumn("pos", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("pos") <= k + 1).select("rep", "id"), "some-copies")
    wide = best.select("a", "b", "sim").join(some.select(F.col("rep").alias("b"), "id"), "b", "left").select("a", F.coalesce("id", "b").alias("b"), "sim")
    wide = cut(_top(wide, k).select("a", "b", "sim"), "expanded")
    mates = some.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).cast("float").alias("sim"))
    each = copies.join(wide.unionByName(mates).withColumnRenamed("a", "rep"), "rep").where("id <> b").select(F.col("id").alias("a"), "b", "sim")
    return _top(wide.join(copies, F.col("a") == F.col("id"), "left_anti").unionByName(each), k)


def nearest(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """``a, b, sim, rank``: the k most similar sessions of every session with a usable vector.

    Comparable are vectors of the same model, model_revision and dimensions
    (null equals null). Per session the row with the latest computed_at counts
    (null is earliest; of equal ones the largest). Usable: as many values as
    dimensions says, all finite, not all zero. Others have no neighbours, an
    empty table gives none, and a group of n gives each member n - 1 at most.
    Equal vectors are neighbours with similarity 1; of more than k ties the
    smallest ids of those seen count. Extra columns are ignored.
    """
    every = cut(latest_usable(embeddings), "unit-vectors", sweep=True)
    copies = cut(copies_of(every), "copies", sweep=True)
    repeated = not copies.isEmpty()
    rows = every.join(copies.where("id <> rep"), "id", "left_anti") if repeated else every
    perms = cut(permutations(rows, choose_pivots(rows)), "permutations", sweep=True)
    uncut(every)  # all of it that is needed is in perms and copies
    size, long = _bytes(perms, F.lit(1)), long_lists(perms)
    total = POSTED * size + _bytes(long, F.col("rows") - F.col("members"))
    best = _in_passes(None, posted(perms, long), ["g", "p1", "qb", "mb"], total, size, k)
    sizes = perms.groupBy("g").agg(F.count("*").alias("n"))  # a row per model, revision and dimensions
    have = best.groupBy("a").agg(F.count("*").alias("have"))
    # ids first: the vectors of the few that found too little are read only if there are any
    short = (perms.select("id", "g").join(have, F.col("id") == F.col("a"), "left").join(F.broadcast(sizes), "g")
             .where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id"))
    short = cut(short, "short", sweep=True)
    if not short.isEmpty():
        best = _whole(best, perms, perms.join(short, "id", "left_semi"), size, k)
    uncut(perms)
    return _with_copies(best, copies, k) if repeated else best


def neighbour_pairs(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """``session_id_a < session_id_b``: pairs of which one is among the k nearest of the other."""
    return nearest(embeddings, k).select(F.least("a", "b").alias("session_id_a"), F.greatest("a", "b").alias("session_id_b")).distinct()

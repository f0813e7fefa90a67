"""Exact nearest vectors for a stated set of queries, and unions of result lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.store import first_by

#: Bytes of queries that are broadcast for one pass over the table; more are taken block by block. At 384 dimensions that is 43,690 queries.
BLOCK_BYTES = 64 << 20
#: Queries multiplied at once.
AT_ONCE = 1024


def fresh(vectors: DataFrame) -> DataFrame:
    """One usable row per session: the one computed last; if that one is unusable, none."""
    last = first_by(vectors.where("session_id is not null"), ["session_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("model_revision"), F.desc_nulls_last("source_hash")])
    return last.where(E.usable("vector", "dimensions")).select("session_id", "model", "model_revision", "dimensions", "vector")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, session_id, similarity, rank``: the k most similar rows of the query's model, revision and dimensions.

    Exact: queries are taken in blocks of ``BLOCK_BYTES`` and every row is
    compared with the block in one pass over the table; each task keeps its k
    best per query, so what is shuffled is k rows per query and task. Ties at six
    digits go to the larger session id. A query does not find itself.
    """
    spark = rows.sparkSession
    schema = "query_id bigint, session_id bigint, similarity double"
    out, after = None, None
    cols = ["session_id", "model", "model_revision", "dimensions", "vector"]
    widest = queries.agg(F.max("dimensions")).first()[0] or 1
    while True:
        q = queries if after is None else queries.where(F.col("session_id") > after)
        block = q.orderBy("session_id").limit(max(1, BLOCK_BYTES // (4 * widest))).select(*cols).toArrow()
        if not block.num_rows:
            break
        after = block.column("session_id")[-1].as_py()
        keys = list(zip(*(block.column(c).to_pylist() for c in cols[1:4])))
        groups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for key in set(keys):
            own = block.take(pa.array([i for i, x in enumerate(keys) if x == key]))
            groups[key] = own.column("session_id").to_numpy(), own.column("vector").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(own.num_rows, -1)
        shared = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, int]]] = {}
            unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
            for batch in batches:
                keys = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
                for key in set(keys) & set(shared.value):
                    at = [i for i, x in enumerate(keys) if x == key]
                    ids, x = shared.value[key]
                    here = batch.column(0).take(pa.array(at)).to_numpy()
                    v = unit(batch.column(4).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1).astype(np.float64)).T
                    for k0 in range(0, len(ids), AT_ONCE):
                        some = ids[k0:k0 + AT_ONCE]
                        sims = np.round(np.clip(unit(x[k0:k0 + AT_ONCE].astype(np.float64)) @ v, -1, 1), 6)
                        sims[some[:, None] == here[None, :]] = -9
                        for i, row in zip(some.tolist(), sims):
                            order = np.lexsort((-here, -row))[:k]
                            best[i] = sorted(best.get(i, []) + [(float(row[j]), int(here[j])) for j in order if row[j] > -2], reverse=True)[:k]
            flat = [(i, s, c) for i, found in best.items() for c, s in found]
            cols = list(zip(*flat)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "session_id", "similarity"])

        part = rows.select(*cols).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("session_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ordered_union(first: DataFrame, second: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows of the first list in its order, then those only the second has, in its order."""
    both = first.select(key, rank).withColumn("list", F.lit(0)).unionByName(second.select(key, rank).withColumn("list", F.lit(1)))
    kept = both.groupBy(key).agg(F.min(F.struct("list", rank)).alias("x"))
    return kept.select(key, F.row_number().over(Window.orderBy("x.list", f"x.{rank}", key)).alias("position"))

"""Token ids of a whole corpus (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

#: Rows encoded before a result batch is handed on.
ROWS = 512


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give ``id_col`` and ``ids`` (the token ids of ``text_col``) of every row.

    ``vocabulary`` is a rank file of a public tokenizer; every worker loads it
    once. Encoding is a streaming transducer (:mod:`tidemark.llm.bpe`), one pass
    without a shuffle. Null and empty texts give the empty list, strings that
    look like special tokens are plain text, other columns are ignored whatever
    their names, repeated rows each give a row, an empty table gives none.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary).encode
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; null and empty texts have 0."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary).encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)

"""Token ids of all documents as compact binary files, and back.

The file format is a table of chunks in ascending ``doc_id`` order. A chunk holds whole
documents: their ids (``doc_ids``), how many token ids each has (``lengths``), and the token ids
as blocks of the range coder (``blocks``) with a CRC-32 each (``checks``). Every block starts
with fresh statistics and can be decoded by itself; every chunk is read by itself, so reading
is spread over tasks in any way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.llm import range_coder
from askgrade.llm.common import numbered, small_batches, whole_texts
from askgrade.llm.tokens import encoder
from askgrade.session import materialise, new_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CHUNK_IDS = 1 << 22
ENCODED_AT_ONCE = 100
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCHEMA = "part int, chunk int, doc_ids array<long>, lengths array<long>, blocks array<binary>, checks array<long>"


def _chunk(part: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
    lengths = [len(x) for x in ids]
    blocks, checks = range_coder.encode(np.concatenate(ids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary())),
            pa.array([checks], pa.list_(pa.int64())),
        ],
        ["part", "chunk", "doc_ids", "lengths", "blocks", "checks"],
    )


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    coder = encoder(VOCABULARY)
    doc_ids: list[int | None] = []
    ids: list[np.ndarray] = []
    waiting = 0
    end = np.array([END_ID], np.uint16)
    for batch in batches:
        for at in range(0, len(batch), ENCODED_AT_ONCE):
            some = batch.slice(at, ENCODED_AT_ONCE)
            for doc_id, own in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist())):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([own, end]))
                waiting += len(ids[-1])
                if waiting >= CHUNK_IDS:
                    yield _chunk(part, number, doc_ids, ids)
                    number, doc_ids, ids, waiting = number + 1, [], [], 0
    coder.rest()
    if ids:
        yield _chunk(part, number, doc_ids, ids)


def write(documents: DataFrame, path: str) -> None:
    """Write the token ids of every whole text and the end id in ascending ``doc_id`` order.

    A null id comes first; rows repeated with one id stand together in any order. A null or
    empty text has the end id only. Extra columns are left behind.
    """
    rows = whole_texts(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    small_batches(rows).mapInArrow(_encode, SCHEMA).write.parquet(path)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            lengths = row["lengths"]
            ids = range_coder.decode(row["blocks"], row["checks"], sum(lengths)).astype("<u4")
            cuts = np.cumsum([0, *lengths])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()),
                    pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["part", "chunk", "nth", "doc_id", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, chunk, nth`` (the place), ``doc_id, n_tokens, ids_crc32`` of every document in the
    files; a damaged block fails the read."""
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(
        _decode, "part int, chunk int, nth int, doc_id long, n_tokens long, ids_crc32 long"
    )


def round_trip(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from files written and read again.

    ``start`` counts the ids of all documents before it in the files. An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    path = new_path(spark, "token-ids")
    write(documents, path)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, 4)  # a chunk is some megabytes
    try:
        found = materialise(read(spark, path), "token-ids-read")
    finally:
        spark.conf.set(_BATCH, before)
    return numbered(found, ["part", "chunk", "nth"], "start", F.col("n_tokens")).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )

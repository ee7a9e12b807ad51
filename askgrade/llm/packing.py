"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit, longest first. Documents (pieces of at most a sequence) are sorted by
ranges of their length, which gives every one its rank; gaps are kept sorted by size. A round
takes all documents of one length: their successors are the smallest gaps that hold them. Where
many want the same gap, the rank decides: of a run of equal documents the first takes the first
gap of a run of equal gaps, and so on, as many to a gap as fit. The gaps shrink, the documents
left over open new sequences, and the next round begins.

Equal documents and equal gaps are interchangeable, so the rounds handle runs of them: lengths
and gap sizes have at most ``capacity`` values, whatever the number of documents. The number of
documents of each length is all that the rounds take from the data, and runs of ranks with their
places all they give back; each task finds its documents' places by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import numbered, small_batches, whole_texts
from askgrade.llm.tokens import encoder
from askgrade.session import materialise

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0


def _pieces(vocabulary: str, end_id: int, capacity: int) -> Callable:
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                ids = np.concatenate([ids.astype("<u4"), end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        coder.rest()

    return pieces


def token_pieces(
    documents: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and the end id, cut into pieces
    of ``capacity`` ids; the last piece may be shorter."""
    return small_batches(whole_texts(documents)).mapInArrow(
        _pieces(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(counts: np.ndarray) -> np.ndarray:
    """Runs of documents and their places, from the number of documents of each length.

    ``counts[s]`` is the number of documents of length ``s``; ``len(counts) - 1`` the capacity.
    A row holds: first rank, in the order of falling length; length; documents in a sequence;
    first sequence; offset of the first of them.
    """
    capacity = len(counts) - 1
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # first sequence, sequences
    filled = np.zeros(capacity + 1, bool)
    rows: list[tuple[int, int, int, int, int]] = []
    rank = sequences = 0
    for size in range(capacity, 0, -1):
        left = int(counts[size])

        def place(gap: int, first: int, number: int) -> int:
            """Fill up to ``number`` sequences with this gap; returns how many were used."""
            nonlocal left, rank
            each = gap // size
            full = min(number, left // each)
            if full:
                rows.append((rank, size, each, first, capacity - gap))
                keep(gap - each * size, first, full)
                rank += full * each
                left -= full * each
            if left and full < number:
                rows.append((rank, size, left, first + full, capacity - gap))
                keep(gap - left * size, first + full, 1)
                rank += left
                left = 0
                full += 1
            return full

        def keep(gap: int, first: int, number: int) -> None:
            if gap:
                gaps[gap].append((first, number))
                filled[gap] = True

        while left:
            fits = np.flatnonzero(filled[size:])
            if not len(fits):
                break
            gap = size + int(fits[0])
            runs, gaps[gap] = gaps[gap], []
            filled[gap] = False
            for first, number in runs:
                used = place(gap, first, number) if left else 0
                if used < number:
                    keep(gap, first + used, number - used)
        if left:
            each = capacity // size
            number = -(-left // each)
            sequences += place(capacity, sequences, number)
    return np.array(rows, np.int64).reshape(-1, 5)


def _places(shared) -> Callable:
    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            run = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
            inside = rank - run[:, 0]
            sequence = run[:, 3] + inside // run[:, 2]
            offset = run[:, 4] + inside % run[:, 2] * run[:, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return places


def packed(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    A null or empty text has one piece, the end id. Rows repeated with one id are packed each.
    An empty table gives an empty result. Extra columns are left behind.
    """
    pieces = materialise(token_pieces(documents, capacity=capacity), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # ``capacity`` rows at most
        counts[row["length"]] = row["count"]
    ranked = numbered(
        pieces.withColumn("shortness", -F.col("length")), ["shortness", "doc_id", "piece"], "rank"
    ).drop("shortness")
    shared = documents.sparkSession.sparkContext.broadcast(best_fit(counts))
    return ranked.mapInArrow(
        _places(shared),
        """doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long""",
    )

"""Steps that several operators share: whole texts, row numbers, word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrade.session import materialise

SLICE_BYTES = 1 << 20
#: What a Python worker keeps for the next task of the same operator; others clear it first.
HELD: dict = {}
BATCH_ROWS = 400
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return memory that a Python worker no longer uses, since another step may run in it next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def let_go() -> None:
    """Drop what another operator kept in this worker."""
    if HELD:
        HELD.clear()
        give_back()


def free_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver's JVM has
    collected their plans, which a driver with room to spare puts off for long."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def whole_texts(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and the named columns; any others are left behind,
    so that extra columns cannot clash with an operator's own."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small, in rows and in bytes, since one row may hold a very long text and
    long texts may stand together."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def numbered(df: DataFrame, order: list[str], name: str, amount: Column | None = None) -> DataFrame:
    """``df`` (narrow rows) with ``name``: the sum of ``amount`` over all rows before it in the
    order of ``order`` (nulls first), thus a 0-based row number if ``amount`` is not given.

    The rows are sorted by ranges and written once; only one sum per partition meets in a
    single task. Rows equal in ``order`` are numbered in any order.
    """
    step = F.lit(1).cast("long") if amount is None else amount.cast("long")
    spread = df.withColumn("_step", step).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(
        spread.withColumn("_place", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright("_place", 33))
    run = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum("_step").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    if amount is None:
        inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        inside = F.coalesce(F.sum("_step").over(run), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_step", "_place", "_part", "_start", "_inside")
    )


# --- words of many texts at once, as 64-bit hashes
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
#: Word hashes are polynomials modulo these primes; modulo a power of two, polynomials of some pairs
#: of long regular words are equal for every base.
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_318_699_003, 1_702_766_719)
#: As many products of a letter and a power can be added up in 64 bits.
_ADDABLE = 1 << 23
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** i`` modulo ``prime`` for ``i < n``."""
    known = _POWERS.get((base, prime))
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES)
        known = np.ones(size, np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, prime))
            known[done : done + more] = known[:more].astype(np.uint64) * step % np.uint64(prime)
            done += more
        if n <= 2 * SLICE_BYTES:
            _POWERS[base, prime] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers, well mixed (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string array with about SLICE_BYTES each (a longer text is a piece of its own):
    first row, end row, bytes, byte offsets of the rows in them. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte lengths of the words (runs without white space, A-Z lower-cased), and for
    each text the number of words before it (one more entry at the end)."""
    word = ~SPACES[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    cuts = offsets[1:-1]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    letters = _LOWER[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    parts = []
    for base, prime in zip(_BASES, _PRIMES):
        values = letters * _powers(base, prime, len(data))
        if len(data) > _ADDABLE:
            values %= np.uint64(prime)
        np.cumsum(values, out=sums[1:])
        back = _powers(pow(base, -1, prime), prime, len(data) + 1)[starts]
        parts.append((sums[ends] - sums[starts]) % np.uint64(prime) * back % np.uint64(prime))
    hashes = mixed((parts[0] << np.uint64(32)) | parts[1])
    return hashes, ends - starts, np.searchsorted(starts, offsets)


@contextmanager
def arrow_batches(spark, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Jobs started inside send at most ``rows`` rows or about ``size`` bytes (one row at least) in
    an Arrow batch; the session's own settings are back afterwards."""
    settings = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": rows,
        "spark.sql.execution.arrow.maxBytesPerBatch": size,
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


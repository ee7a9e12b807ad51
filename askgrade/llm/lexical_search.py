"""Ranked lexical search by dense blocked matrix products.

Items are taken in blocks with a bounded vocabulary. One pass over the documents keeps, of every
whole text, its length in terms and how often it holds each term of the block; document
frequencies, the number of documents and their length are added up from all of these. Then tiles
are multiplied: the items' weights over the terms that a tile of documents holds (the compact
vocabulary) times the documents' impacts on these terms, in float64 with BLAS.

* All weights and impacts are integers. An item's weights are dealt to layers so that no partial
  sum of a product can reach 2^53; a layer's product is exact, and layers are added up as
  64-bit integers.
* The best of a tile are cut behind the last tied score, then by id, so ties are never lost.
  A task keeps ``top`` documents an item; these rows are ranked in two steps, the first on
  (item, salt), so that no task sees the rows of all tasks for an item at once.

Very long texts are split into terms a slice at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from askgrade.llm.common import arrow_batches, numbered, whole_texts
from askgrade.session import materialise

TOP = 20
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Terms (with repeats) of a block of items; an item with more is a block of its own.
BLOCK_TERMS = 1 << 16
BLOCK_ITEMS = 512
#: Cells of a tile of documents, and documents in it.
TILE_CELLS = 1 << 21
TILE_DOCS = 512
SLICE = 1 << 20
SALTS = 16

# --- fixed values of the score
IMPACT = 1_000_000_000
#: Impacts are below IMPACT / 1000, so sums of weights up to this stay below 2^53.
LAYER_WEIGHT = (1 << 53) // (IMPACT // 1000) - 1


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, lower-cased, about SLICE bytes at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            cut = _BETWEEN.search(text, at + SLICE)
            end = cut.start() if cut else end
        yield TERM.findall(text[at:end].lower())  # bytes: only A-Z change
        at = end


def _counted(ids: dict[bytes, int]):
    """Documents as (doc_id, n, terms, tf) with the terms' numbers in the block's vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.keys()
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, found = 0, Counter()
                for some in term_slices(text):
                    n += len(some)
                    found.update(filter(known.__contains__, some))
                lengths.append(n)
                terms.append([ids[t] for t in found])
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "tf"],
            )

    return run


def weight(n: int, df: int) -> int:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))


def layers(items: list[dict[int, int]]) -> list[list[tuple[int, int, int]]]:
    """(item, term, weight) entries dealt to layers in which no item's weights pass LAYER_WEIGHT."""
    out: list[list[tuple[int, int, int]]] = [[]]
    for i, own in enumerate(items):
        layer, free = 0, LAYER_WEIGHT
        for term, total in own.items():
            while total > 0:
                if not free:
                    layer, free = layer + 1, LAYER_WEIGHT
                if layer == len(out):
                    out.append([])
                part = min(total, free)
                out[layer].append((i, term, part))
                total, free = total - part, free - part
    return out


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * N) div L."""
    if len(n) and 25 * int(n.max()) * documents < 1 << 63:
        m = 75 + (25 * n * documents) // length
    else:  # beyond 64 bits on the way
        m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
    return (IMPACT * tf) // (1000 * tf + 12 * m)


def _ranked(shared, documents: int, length: int, top: int):
    """Best documents of a task for every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, n_terms, stack = shared.value
        dense = np.zeros((len(stack), n_items, n_terms))
        for layer, (item, term, value) in enumerate(stack):
            dense[layer, item, term] = value
        best = Best(n_items, top)
        for batch in batches:
            for tile in tiles(batch):
                ids, missing, n, row, term, tf = tile
                value = impacts(tf, n[row], documents, length)
                present, place = np.unique(term, return_inverse=True)  # the compact vocabulary
                block = np.zeros((len(present), len(ids)))
                block[place, row] = value
                score = np.zeros((n_items, len(ids)), np.int64)
                for layer in dense:
                    score += (layer[:, present] @ block).astype(np.int64)
                best.take(score, ids, missing)
        item, ids, missing, score = best.rows()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=missing), pa.array(score, pa.int64()),
                pa.array([TaskContext.get().partitionId() % SALTS] * len(ids), pa.int32()),
            ],
            ["item", "doc_id", "score", "salt"],
        )

    return run


def tiles(batch: pa.RecordBatch):
    """Documents of a batch by tile: ids, which are null, lengths; row, term and tf of each entry."""
    doc_id, lists = batch.column("doc_id"), batch.column("terms")
    missing = np.asarray(doc_id.is_null())
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    term = lists.flatten().to_numpy(zero_copy_only=False)
    tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ids):
        docs, seen = 1, int(cuts[at + 1] - cuts[at])
        while at + docs < len(ids) and docs < TILE_DOCS:
            more = int(cuts[at + docs + 1] - cuts[at + docs])
            if (seen + more) * (docs + 1) > TILE_CELLS:  # the tile has as many terms at most
                break
            docs, seen = docs + 1, seen + more
        some = slice(int(cuts[at]), int(cuts[at + docs]))
        row = np.repeat(np.arange(docs), np.diff(cuts[at : at + docs + 1]))
        yield ids[at : at + docs], missing[at : at + docs], n[at : at + docs], row, term[some], tf[some]
        at += docs


class Best:
    """The best documents of each item so far: highest score, then smallest id, a null id last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]

    def take(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        for i, own in enumerate(score):
            old_ids, old_missing, old_score = self.held[i]
            full = len(old_score) == self.top
            # everything tied with the last one held, or with the last of the best in the tile, stays in
            least = max(1, int(old_score[-1])) if full else 1
            if len(own) > self.top:
                least = max(least, int(np.partition(own, len(own) - self.top)[len(own) - self.top]))
            good = np.flatnonzero(own >= least)
            if not len(good):
                continue
            s = np.concatenate([old_score, own[good]])
            d = np.concatenate([old_ids, ids[good]])
            m = np.concatenate([old_missing, missing[good]])
            order = np.lexsort((d, m, -s))[: self.top]
            self.held[i] = d[order], m[order], s[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(self.held)), [len(s) for _, _, s in self.held])
        d, m, s = (np.concatenate(x) for x in zip(*self.held))
        return item, d, m, s


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Rows (item_id, terms) of the items, block by block, in the order of their ids."""
    spark = items.sparkSession
    named = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            terms = [[t for some in term_slices(x) for t in some] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([len(t) for t in terms], pa.int64()), pa.array(terms, pa.list_(pa.binary()))],
                ["item_id", "n", "terms"],
            )

    schema = "item_id long, n long, terms array<binary>"
    with arrow_batches(spark, 1000):
        found = named.mapInArrow(split, schema).where("n > 0")
        found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "items")
    # a block is full of terms or of items: an item counts as so many terms at least
    taken = F.greatest(F.col("n"), F.lit(BLOCK_TERMS // BLOCK_ITEMS))
    placed = numbered(found.select("item_id", "row", taken.alias("taken")), ["item_id", "row"], "before", F.col("taken"))
    placed = materialise(placed.select("row", F.floor(F.col("before") / BLOCK_TERMS).alias("block")), "item-blocks")
    rows = found.join(placed, "row")
    for (block,) in placed.select("block").distinct().orderBy("block").toLocalIterator():
        yield rows.where(F.col("block") == block).orderBy("item_id", "row").collect()


def _search_block(items: list[Row], documents: DataFrame, top: int) -> DataFrame:
    spark = documents.sparkSession
    terms = sorted({bytes(t) for item in items for t in item["terms"]})
    ids = {t: i for i, t in enumerate(terms)}
    with arrow_batches(spark, 2000):
        counted = materialise(
            whole_texts(documents).mapInArrow(_counted(ids), "doc_id long, n long, terms array<int>, tf array<long>").where("n > 0"),
            "search-counts",
        )
    size = counted.agg(F.count("*"), F.sum("n")).first()
    total, length = size[0], size[1] or 1
    # as many rows as the block has terms at most
    frequency = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())
    weights = [
        {ids[t]: k * weight(total, frequency[ids[t]]) for t, k in Counter(map(bytes, item["terms"])).items() if ids[t] in frequency}
        for item in items
    ]
    stack = [tuple(np.array(x) for x in zip(*layer)) for layer in layers(weights) if layer]
    shared = spark.sparkContext.broadcast((len(items), len(terms), stack))
    with arrow_batches(spark, 2000):
        best = materialise(
            counted.where(F.size("terms") > 0).mapInArrow(
                _ranked(shared, total, length, top), "item int, doc_id long, score long, salt int"
            ),
            "search-best",
        )
    shared.unpersist()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    named = spark.createDataFrame([(i, item["item_id"]) for i, item in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, documents: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0.

    Equal scores are ranked by ascending ``doc_id``, a null id last. Null and empty texts, and texts
    without a term, are found by no item and do not count; items without a term have no rows. A
    repeated row of ``items`` is an item of its own, one of ``documents`` a document of its own.
    Empty tables give an empty result. Other columns are left behind.
    """
    found = [_search_block(block, documents, top) for block in _blocks(items)]
    if not found:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)

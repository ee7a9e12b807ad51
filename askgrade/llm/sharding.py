"""Shards of near equal size by sampled splitters.

The key of a record is (digest of the text, ``doc_id``, place in the narrow table), so equal texts
lie next to each other. A sample in which a record's chance grows with its size gives quantiles
of the bytes along the key; these are the splitters of ranges, about ``PIECES`` for a shard.
Exact bytes and rows of every range are added up, and a range that is overfull is subdivided
by a sample of its own until none is or only single records are left. Then ranges go to shards,
the largest first, each to the shard with the fewest bytes.

* Splitters lie between different texts, so equal texts stay in one range and one shard; only a
  range of one text that is itself overfull is split by ``doc_id`` and place.
* A range holds at most ``RANGE_ROWS`` rows, which bounds the task that numbers them. What the
  driver and every task hold are splitters and sums of ranges: ``PIECES`` for a shard, and one
  for ``RANGE_ROWS / 4`` rows beyond (1,600 kB for 10^10 rows), never rows.
* Only narrow rows move; ``write_shards`` moves texts once, to their shards' files.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrade.llm.common import arrow_batches, whole_texts
from askgrade.session import materialise

SHARDS = 16
PIECES = 64
#: Sampled records for each range to be cut.
SAMPLES = 24
RANGE_ROWS = 1 << 20
#: A range is overfull beyond so many times the mean bytes or rows of a range.
OVERFULL = 4
#: Equal texts stay in one shard up to this share of its bytes.
TOGETHER = 0.25
LAW = "bytes"
KEY = ["digest", "doc_id", "place"]


def records(documents: DataFrame, *more: str) -> DataFrame:
    """Narrow rows ``doc_id, size, text_crc32, digest, place``; size is the text's bytes plus 1."""
    text = F.col("text").cast("binary")
    return whole_texts(documents, *more).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("digest"),
        *(F.col(c) for c in more),
    )


@dataclass
class Splitters:
    """First keys of the ranges but the first, ascending. A null id sorts before all others."""

    digest: np.ndarray
    known: np.ndarray  # 0 for a null id, 1 for another
    doc_id: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(keys: Iterable[tuple]) -> Splitters:
        table = np.array(sorted(set(keys)), np.int64).reshape(-1, 4)
        return Splitters(*table.T)

    def keys(self) -> list[tuple]:
        return list(zip(*(x.tolist() for x in (self.digest, self.known, self.doc_id, self.place))))

    def find(self, digest, known, doc_id, place) -> np.ndarray:
        """Number of the range of each record: how many splitters are not above its key."""
        low = np.searchsorted(self.digest, digest, "left")
        high = np.searchsorted(self.digest, digest, "right")
        out = low.copy()
        for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b}:  # texts cut by splitters
            rows = np.flatnonzero((low == a) & (high == b))
            n = np.concatenate([np.zeros(b - a, bool), np.ones(len(rows), bool)])  # a splitter's own key is in its range
            columns = [np.concatenate([mine[a:b], theirs[rows]]) for mine, theirs in
                       ((self.place, place), (self.doc_id, doc_id), (self.known, known))]
            order = np.lexsort([n, *columns])
            passed = np.cumsum(~n[order])
            out[rows[order[n[order]] - (b - a)]] = a + passed[n[order]]
        return out


#: Splitters for a text as a whole: before every key with its digest.
def _before_text(digest: int) -> tuple:
    return digest, -1, 0, 0


def _with_range(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """``rows`` with the number of their range; only keys go to Python, with the splitters."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("long")
    def number(digest: pd.Series, known: pd.Series, doc_id: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(shared.value.find(*(x.to_numpy() for x in (digest, known, doc_id, place))))

    known = F.col("doc_id").isNotNull().cast("long")
    doc_id = F.coalesce("doc_id", F.lit(0).cast("long"))
    return rows.withColumn("range", number("digest", known, doc_id, "place"))


def _sampled(rows: DataFrame, share) -> DataFrame:
    """A record is drawn with a chance of ``share`` times its size, and counts for more than one
    if that is above 1; the draw depends on its key only."""
    chance = F.col("size") * share
    draw = F.pmod(F.xxhash64(*KEY, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < chance).withColumn("mass", F.greatest(chance, F.lit(1.0)))


def _quantiles(sample: DataFrame, pieces) -> DataFrame:
    """Splitters of every range: where the running mass of its sample passes an n-th part of it.

    A splitter is moved to the front of its text, unless that is where the range begins.
    """
    by = Window.partitionBy("range")
    order = by.orderBy(*KEY)
    passed = F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = (
        sample.withColumn("pieces", pieces)
        .withColumn("all", F.sum("mass").over(by))
        .withColumn("first", F.min("digest").over(by))
        .withColumn("to", F.floor(passed * F.col("pieces") / F.col("all") - 1e-9))
        .withColumn("from", F.floor((passed - F.col("mass")) * F.col("pieces") / F.col("all") - 1e-9))
    )
    return marked.where((F.col("to") > F.col("from")) & (F.col("from") >= 0)).select("digest", "doc_id", "place", "first", "range")


def _keys(found: DataFrame) -> list[tuple]:
    out = []
    for r in found.collect():
        out.append(_before_text(r["digest"]))
        if r["digest"] == r["first"]:
            out.append((r["digest"], int(r["doc_id"] is not None), r["doc_id"] or 0, r["place"]))
    return out


def _sums(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("largest"),
        F.min("digest").alias("low"), F.max("digest").alias("high"),
    )


def cut(rows: DataFrame, shards: int = SHARDS) -> tuple[Splitters, list]:
    """Splitters of ``rows`` (a written table of narrow rows), and the sums of their ranges."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return Splitters.of([]), []
    pieces = shards * PIECES
    whole = _sampled(rows.withColumn("range", F.lit(0)), F.lit(SAMPLES * pieces / total))
    splitters = Splitters.of(_keys(_quantiles(whole, F.lit(pieces)).where("range >= 0")))
    most = OVERFULL * total / pieces
    most_rows = min(RANGE_ROWS, max(1, OVERFULL * n / pieces))
    while True:
        ranged = _with_range(rows, splitters)
        sums = _sums(ranged).collect()
        over = [r for r in sums if r["rows"] > most_rows or r["rows"] > 1 and r["bytes"] > most]
        if not over:
            return splitters, sums
        # as many pieces as make them a quarter of what is allowed
        todo = [(r["range"], max(2, int(4 * max(r["rows"] / most_rows, r["bytes"] / most))), r["bytes"]) for r in over]
        plan = rows.sparkSession.createDataFrame(todo, "range long, pieces long, bytes long")
        inside = ranged.join(F.broadcast(plan), "range")
        sample = _sampled(inside, F.lit(float(SAMPLES)) * F.col("pieces") / F.col("bytes"))
        more = set(_keys(_quantiles(sample, F.col("pieces")))) - set(splitters.keys())
        if not more:  # the sample met one record only: cut at the two largest
            order = Window.partitionBy("range").orderBy(F.col("size").desc(), *KEY)
            first = F.min("digest").over(Window.partitionBy("range")).alias("first")
            top = inside.select("*", first).withColumn("n", F.row_number().over(order)).where("n <= 2")
            more = set(_keys(top)) - set(splitters.keys())
        if not more:
            return splitters, sums
        splitters = Splitters.of([*splitters.keys(), *more])


def deal(sums: list, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """(range, shard, rows of the shard in earlier ranges): largest first to the emptiest shard.

    Ranges between which a text was cut stay together up to a share of a shard.
    """
    units: list[list] = []
    most = TOGETHER * sum(r["bytes"] for r in sums) / shards
    held = 0
    for r in sorted(sums, key=lambda r: r["range"]):
        if units and units[-1][-1]["high"] == r["low"] and held + r["bytes"] <= most:
            units[-1].append(r)
            held += r["bytes"]
        else:
            units.append([r])
            held = r["bytes"]
    heap = [(0, s) for s in range(shards)]
    found: list[tuple[list, int]] = []
    for bytes_, first, unit in sorted((-sum(r["bytes"] for r in u), u[0]["range"], i) for i, u in enumerate(units)):
        filled, s = heapq.heappop(heap)
        found.append((units[unit], s))
        heapq.heappush(heap, (filled - bytes_, s))
    before = dict.fromkeys(range(shards), 0)
    out = []
    for unit, s in sorted(found, key=lambda x: x[0][0]["range"]):
        for r in unit:
            out.append((r["range"], s, before[s]))
            before[s] += r["rows"]
    return out


def placed(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, shards from 0.

    The law is ``bytes``: shards have nearly equal sums of sizes. Equal texts are in one shard
    unless they hold more than a quarter of its bytes. Slots number a shard's rows from 0 along
    the key. A null text is empty (size 1); null ids come first among equal texts; repeated rows
    are rows of their own; more shards than rows leave shards empty; an empty table gives an empty
    result; very long texts are a record that is never cut. Other columns are left behind.
    """
    spark = documents.sparkSession
    rows = materialise(records(documents).withColumn("place", F.monotonically_increasing_id()), "shard-records")
    with arrow_batches(spark, 100_000):
        splitters, sums = cut(rows, shards)
        ranged = materialise(_with_range(rows, splitters), "shard-ranges")
    plan = spark.createDataFrame(deal(sums, shards), "range long, shard int, before long")
    order = Window.partitionBy("range").orderBy(F.col("digest"), F.col("doc_id").asc_nulls_first(), F.col("place"))
    return (
        ranged.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(plan), "range")
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
            (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "place",
        )
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole rows with all their columns as Parquet below ``path/shard=<n>/``; texts move once."""
    row = F.struct("*").alias("row")
    whole = documents.select("doc_id", "text", row, F.monotonically_increasing_id().alias("place"))
    rows = records(materialise(whole, "shard-input"), "row", "place")
    with arrow_batches(documents.sparkSession, 100_000):
        splitters, sums = cut(rows.drop("row"), shards)
        plan = documents.sparkSession.createDataFrame(deal(sums, shards), "range long, shard int, before long")
        spread = _with_range(rows, splitters).join(F.broadcast(plan), "range").repartition("shard", "range")
        spread.select("row.*", "shard").write.partitionBy("shard").parquet(path)

"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a given share.

A ``Measure`` gives the words of a shingle and the share; ``t`` below is that share.

1. Equal sets are one class; only classes are compared.
2. Shingles fall into 2^22 token classes by their hash, and all documents' shingles are counted
   by class. A shingle of a class with a large count is frequent, any other rare. Rare shingles
   come first in the global order, so a prefix of ``n - ceil(t n) + 1`` shingles of any set
   holds one of those it shares with a partner.
3. If that one is rare, both sets meet in the index of single rare shingles. If the partners
   share no rare shingle, they differ in fewer frequent ones than a set has groups when its
   frequent shingles are dealt by hash into one group more than the largest difference; so one
   group, a combination of several shingles, is the same in both, and the index holds these.
4. Candidates whose sizes, or whose bitmaps of ``BITS`` parities (more for larger sets, since a bitmap
   shorter than the limit cannot show it), show a difference beyond the limit
   go; the bitmaps of two sets differ in no more places than the sets. The others are verified
   on whole sets. A first round links every set with two neighbours of
   each posting; a second verifies the remaining pairs that are still in different components,
   since pairs within a component cannot change it. So groups of thousands of near copies do
   not make all their pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrade.llm.common import free_shuffles, let_go, mixed, small_batches, text_slices, whole_texts, word_hashes
from askgrade.llm.components import components, small_side
from askgrade.session import discard, materialise

CLASS_BITS = 22
CHUNKS = 64
SALTS = 64
BITS = 2048
FOLDED = ("f0", "f1", "f2", "f3")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link when ``100 * intersection >= percent * union``."""

    words: int
    percent: int

    @property
    def least(self) -> int:
        """The smallest n with n / (n + 1) >= t; smaller sets differ too much from every other set."""
        return -(-self.percent // (100 - self.percent))

    def needed(self, n: np.ndarray) -> np.ndarray:
        """ceil(t n)"""
        return (self.percent * n + 99) // 100

    def band_of(self, n: np.ndarray) -> np.ndarray:
        """Sizes within a factor t of each other are in the same or in adjacent bands."""
        return np.floor(np.log(n) / np.log(100 / self.percent) + 1e-9).astype(np.int64)

    def most_apart(self, band: int) -> int:
        """The largest difference of two linked sets from this band and the next."""
        both = 2 * (100 / self.percent) ** (band + 2)
        return int(both * (100 - self.percent) / (100 + self.percent) + 1e-6) + 1

    @property
    def foldings(self) -> int:
        """How many times the bitmap of one of two sets of fitting sizes can be twice as long as the other's."""
        return int(np.ceil(np.log2(100 / self.percent) - 1e-9))

    def apart(self, n: str, m: str) -> Column:
        """The largest difference of two linked sets of these sizes."""
        return F.floor((F.col(n) + F.col(m)).cast("long") * (100 - self.percent) / (100 + self.percent))

    def sizes_fit(self, n: str, m: str) -> Column:
        n, m = F.col(n).cast("long"), F.col(m).cast("long")
        return (n * 100 >= m * self.percent) & (m * 100 >= n * self.percent)

    def rare_fit(self) -> Column:
        """Partners that share a combination only have no rare shingle in common."""
        return ~F.col("combined") | (F.col("r") + F.col("q") <= self.apart("n", "m"))

    def linked(self, both: str, sizes: str) -> Column:
        """By the size of the intersection and the sum of both sizes."""
        return 100 * F.col(both) >= self.percent * (F.col(sizes) - F.col(both))


CONTRACT = Measure(3, 90)
SHINGLES = Measure(5, 80)


def _sets(texts: pa.Array, words_each: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a slice and their sets: sorted distinct hashes, offsets, and two keys of each set."""
    for lo, hi, data, offsets in text_slices(texts):
        words, _, first = word_hashes(data, offsets)
        counts = np.diff(first)
        n = np.where(counts == 0, 0, np.maximum(counts - words_each + 1, 1))
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        padded = np.concatenate([words, np.zeros(words_each, np.uint64)])
        short = np.repeat(counts, n)
        hashes = padded[place] * _M1
        for i in range(1, words_each):
            inside = short > i
            step = np.where(inside, padded[place + i], np.uint64(i))
            hashes = (mixed(hashes) + step) * _M1
        hashes = mixed(hashes)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(len(n) + 1))
        keys = []
        for m in (_M1, _M2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ m))])
            keys.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
        yield lo, hi, hashes, bounds, keys[0], keys[1]


def _token_class(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _bitmaps(hashes: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """For each set, the parity of its hashes in each of BITS places (of a power of two not below
    its size, if it is larger), as a list of longs, and in each of 64 * len(FOLDED) places, as columns."""
    sizes = np.diff(bounds)
    places = np.full(len(sizes), BITS, np.int64)
    large = np.flatnonzero(sizes > BITS)
    places[large] = 1 << np.ceil(np.log2(sizes[large])).astype(np.int64)
    ends = np.cumsum(places)
    starts = ends - places
    inside = (hashes & np.repeat(places - 1, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    np.add.at(counts, np.repeat(starts, sizes) + inside, np.uint8(1))
    longs = np.packbits(counts & 1).view(np.int64)
    rows = longs.reshape(-1, len(FOLDED))
    folded = np.bitwise_xor.reduceat(rows, starts // (64 * len(FOLDED))) if len(sizes) else rows
    lists = np.concatenate([[0], ends // 64]).astype(np.int32)
    return pa.ListArray.from_arrays(lists, pa.array(longs)), [pa.array(x) for x in folded.T.copy()]


_COUNTED = """doc_id long, n long, k1 long, k2 long, bits array<long>, f0 long, f1 long, f2 long, f3 long,
    chunk int, counts binary"""
_COUNTED_NAMES = ["doc_id", "n", "k1", "k2", "bits", *FOLDED, "chunk", "counts"]


def _count(measure: Measure) -> Callable:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every document, then the partition's counts of token classes in pieces."""
        let_go()
        total = np.zeros(1 << CLASS_BITS, np.int32)
        any_ = False
        for batch in batches:
            for lo, hi, hashes, bounds, k1, k2 in _sets(batch.column("text"), measure.words):
                any_ = True
                found, counts = np.unique(_token_class(hashes), return_counts=True)
                total[found] += counts.astype(np.int32)
                m = hi - lo
                bits, folded = _bitmaps(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, m), pa.array(np.diff(bounds)), pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)), bits, *folded, pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    _COUNTED_NAMES,
                )
        if any_:
            pieces = [zlib.compress(x.tobytes(), 1) for x in np.split(total, CHUNKS)]
            empty = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    empty, empty, empty, empty, pa.nulls(CHUNKS, pa.list_(pa.int64())), *[empty] * len(FOLDED),
                    pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(pieces, pa.binary()),
                ],
                _COUNTED_NAMES,
            )

    return count


def _sum_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every piece that occurs, with its counts added up; a running sum, so memory
    holds CHUNKS pieces at most, whatever the number of rows."""
    size = (1 << CLASS_BITS) // CHUNKS
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            raw = zlib.decompress(packed.as_py())
            counts = np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64)
            if chunk not in totals:
                totals[chunk] = np.zeros(size, np.int64)
            totals[chunk] += counts
    for chunk, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())],
            ["chunk", "counts"],
        )


def frequent_classes(counted: DataFrame, least: int = 64) -> np.ndarray:
    """One bit for every token class: count over ``least`` and twice the mean.

    Counts are added up where they lie, then by piece; CHUNKS rows reach the driver.
    """
    kind = "chunk int, counts binary"
    rows = counted.where("chunk is not null").select("chunk", "counts").mapInArrow(_sum_chunks, kind)
    rows = rows.repartition("chunk").mapInArrow(_sum_chunks, kind).collect()
    total = np.zeros((CHUNKS, (1 << CLASS_BITS) // CHUNKS), np.int64)
    for row in rows:
        total[row["chunk"]] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.int64)
    total = total.reshape(-1)
    return np.packbits(total > least + 2 * total.mean())


def _postings(frequent_bits, measure: Measure) -> Callable:
    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(frequent_bits.value).astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, hashes, bounds, k1, k2 in _sets(batch.column("text"), measure.words):
                chosen = []
                for i, n in enumerate(np.diff(bounds)):
                    key = (int(k1[i]), int(k2[i]))
                    if n >= measure.least and key not in seen:
                        chosen.append(i)
                        if len(seen) < 1 << 17:  # only spares rows that would be dropped later
                            seen.add(key)
                found = _index(hashes, bounds, np.array(chosen, np.int64), frequent, measure)
                for at in range(0, len(found[0]), 1 << 17):
                    sig, doc, r, combined = (x[at : at + (1 << 17)] for x in found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(sig.view(np.int64)), pa.array(combined), pa.array(k1[doc].view(np.int64)),
                            pa.array(k2[doc].view(np.int64)), pa.array(np.diff(bounds)[doc].astype(np.int32)),
                            pa.array(r.astype(np.int32)),
                        ],
                        ["sig", "combined", "k1", "k2", "n", "r"],
                    )

    return postings


def _index(hashes, bounds, chosen, frequent, measure) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the row of each, its number of rare shingles, and whether it is a combination."""
    n = np.diff(bounds)
    is_chosen = np.zeros(len(n), bool)
    is_chosen[chosen] = True
    owner = np.repeat(np.arange(len(n)), n)
    use = is_chosen[owner]
    hashes, owner = hashes[use], owner[use]
    often = frequent[_token_class(hashes)]
    rare_number = np.bincount(owner[~often], minlength=len(n))
    prefix = n - measure.needed(n) + 1
    r_hash, r_owner = hashes[~often], owner[~often]
    starts = np.searchsorted(r_owner, np.arange(len(n)))
    rank = np.arange(len(r_owner)) - starts[r_owner]
    single = rank < prefix[r_owner]
    parts = [(r_hash[single], r_owner[single], rare_number[r_owner[single]], np.zeros(int(single.sum()), bool))]
    f_hash, f_owner = hashes[often], owner[often]
    starts = np.searchsorted(f_owner, np.arange(len(n) + 1))
    for i in np.flatnonzero(is_chosen & (rare_number <= n - measure.needed(n))):
        mine = f_hash[starts[i] : starts[i + 1]]
        own = int(measure.band_of(n[i]))
        for band in (own - 1, own):
            apart = measure.most_apart(band)
            groups = apart + 2 + apart // 16
            group = (mixed(mine ^ np.uint64(band)) % np.uint64(groups)).astype(np.int64)
            sums = np.zeros(groups, np.uint64)
            np.add.at(sums, group, mixed(mine + _M2))
            filled = np.bincount(group, minlength=groups) > 0
            # only where empty groups alone could agree do they have to be in the index
            wanted = np.arange(groups) if groups - int(filled.sum()) >= groups - apart else np.flatnonzero(filled)
            sig = mixed(mixed(sums[wanted] ^ np.uint64(band + 7)) + wanted.astype(np.uint64))
            m = len(wanted)
            parts.append((sig, np.full(m, i), np.full(m, rare_number[i]), np.ones(m, bool)))
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(4))


def _set_rows(measure: Measure) -> Callable:
    def set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, bounds, k1, k2 in _sets(batch.column("text"), measure.words):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    ["doc_id", "k1", "k2", "s"],
                )

    return set_rows


def _as_short_as(bits: Column, other: Column) -> Column:
    """A bitmap, folded in the middle if the other one is shorter."""
    half = F.shiftright(F.size(bits), 1)
    folded = F.zip_with(
        F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y)
    )
    return F.when(half >= F.size(other), folded).otherwise(bits)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (``a, b``) that are links, as a table. Sets are made again from the texts of candidates only."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    second = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    bits1, bits2 = F.col("bits1"), F.col("bits2")
    for _ in range(measure.foldings):
        bits1, bits2 = _as_short_as(bits1, bits2), _as_short_as(bits2, bits1)
    unlike = F.zip_with(bits1, bits2, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    places = F.aggregate(unlike, F.lit(0), lambda x, y: x + y)
    pairs = (
        pairs.join(first, "a").join(second, "b")
        .where(measure.sizes_fit("n1", "n2") & (places <= measure.apart("n1", "n2")))
        .select("a", "b")
    )
    pairs = materialise(pairs, "jaccard-pairs")
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ends")
    sets = (
        small_batches(texts.join(small_side(ends), "doc_id"))
        .mapInArrow(_set_rows(measure), "doc_id long, k1 long, k2 long, s array<long>")
        .join(nodes.select("node", "k1", "k2"), ["k1", "k2"])
        .where("doc_id = node")
        .select("node", "s")
        .dropDuplicates(["node"])
    )
    sets = materialise(sets, "jaccard-sets")
    free_shuffles(texts.sparkSession)
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s1")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("s").alias("s2")), "b")
        .select("a", "b", F.size(F.array_intersect("s1", "s2")).alias("i"), (F.size("s1") + F.size("s2")).alias("sum"))
    )
    links = materialise(both.where(measure.linked("i", "sum")).select("a", "b"), "jaccard-links")
    for table in (pairs, ends, sets):
        discard(table)
    free_shuffles(texts.sparkSession)
    return links


def linked(documents: DataFrame, measure: Measure = CONTRACT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A set holds the distinct shingles of a whole text (words: runs without white space, A-Z
    lower-cased), the whole sequence if it has fewer words. Sets link by ``measure``, in the
    registered query 3 words and 90 %; ``component_id`` is the smallest id reachable. Null
    and wordless texts have empty sets and link with nothing; so do rows with a null id, whose
    component is null. Rows of one id should be one
    document; if their texts differ, links of either count for the smallest id of equal texts.
    Equal texts are linked. An empty table gives an empty result.
    """
    texts = whole_texts(documents)
    counted = materialise(small_batches(texts).mapInArrow(_count(measure), _COUNTED), "jaccard-counted")
    docs = counted.where("chunk is null").select("doc_id", "n", "k1", "k2", "bits", *FOLDED)
    linkable = docs.where("n > 0 and doc_id is not null")
    nodes = materialise(
        linkable.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits"),
            *[F.first(x).alias(x) for x in FOLDED],
        ),
        "jaccard-nodes",
    )
    shared = texts.sparkSession.sparkContext.broadcast(frequent_classes(counted))
    with_ids = texts.where("doc_id is not null")
    postings = small_batches(with_ids).mapInArrow(
        _postings(shared, measure), "sig long, combined boolean, k1 long, k2 long, n int, r int"
    )
    salt = F.when(F.col("combined"), F.pmod(F.xxhash64("k1"), F.lit(SALTS))).otherwise(0).cast("int")
    # the rare ones of a class are few; combinations may be shared by many and are salted
    order = Window.partitionBy("sig", "salt").orderBy("n", "k1", "k2")
    near = postings.withColumn("salt", salt).select(
        "*", F.row_number().over(order).alias("nth"),
        F.lag(F.struct("k1", "k2", "n", "r")).over(order).alias("before"), F.lead("k1").over(order).alias("next"),
        F.first(F.struct("k1", "k2", "n", "r")).over(order).alias("head"),
    )
    near = materialise(near.where("combined or nth > 1 or next is not null").drop("next"), "jaccard-postings")
    free_shuffles(texts.sparkSession)
    heads = near.where("combined and nth = 1")
    of_heads = Window.partitionBy("sig").orderBy("n", "k1", "k2")  # SALTS rows at most
    heads = heads.select(
        "combined", "k1", "k2", "n", "r", F.lag(F.struct("k1", "k2", "n", "r")).over(of_heads).alias("other")
    )
    first = (
        near.select("combined", "k1", "k2", "n", "r", F.explode(F.array("before", "head")).alias("other"))
        .union(heads)
        .where("other is not null")
        .select("combined", "k1", "k2", "n", "r", *[F.col(f"other.{x}").alias(y) for x, y in zip(("k1", "k2", "n", "r"), ("o1", "o2", "m", "q"))])
        .where(measure.sizes_fit("n", "m") & measure.rare_fit())
        .where("k1 <> o1 or k2 <> o2")
        .select("k1", "k2", "o1", "o2")
        .distinct()
    )
    keys = nodes.select("k1", "k2", "node")
    first = first.join(keys, ["k1", "k2"]).select(F.col("node").alias("a"), F.col("o1").alias("k1"), F.col("o2").alias("k2"))
    first = first.join(keys, ["k1", "k2"])
    links = _verified(first.select("a", F.col("node").alias("b")), nodes, texts, measure)
    found = components(links)
    rest = near.select("sig", "combined", "n", "r", "k1", "k2").join(keys, ["k1", "k2"])
    rest = rest.select("sig", "combined", "n", "r", "node")
    rest = rest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rest.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rest = rest.join(open_.select("sig"), "sig", "left_semi").distinct()
    rest = materialise(rest.join(nodes.select("node", *FOLDED), "node"), "jaccard-open")
    for table in (near, found):
        discard(table)
    free_shuffles(texts.sparkSession)
    # both sides are the same table, so its shuffle is made once
    one, two = rest.alias("one"), rest.alias("two")
    apart = measure.apart("one.n", "two.n")
    unlike = sum(F.bit_count(F.col(f"one.{x}").bitwiseXOR(F.col(f"two.{x}"))) for x in FOLDED)
    second = one.join(
        two,
        (F.col("one.sig") == F.col("two.sig"))
        & (F.col("one.component") < F.col("two.component"))
        & measure.sizes_fit("one.n", "two.n")
        & (~F.col("one.combined") | (F.col("one.r") + F.col("two.r") <= apart))
        & (unlike <= apart),
    ).select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    more = _verified(second, nodes, texts, measure)
    discard(rest)
    final = components(links.union(more), "component")
    classes = nodes.select("k1", "k2", "node").join(final, "node", "left")
    classes = classes.select("k1", "k2", F.coalesce("component", "node").alias("class_component"))
    result = docs.join(classes, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_component"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )
    result = materialise(result, "jaccard-result")
    shared.unpersist()
    for table in (counted, nodes, links, more, final):
        discard(table)
    return result


def one_of_each(docs: DataFrame, measure: Measure = SHINGLES) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id."""
    found = linked(docs.select("doc_id", "text"), measure)
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)

"""Near-duplicate candidates among texts of many shingles."""

import numpy as np
from pyspark.sql import functions as F

from askgrade.llm import jaccard_join
from askgrade.llm.jaccard_join import CONTRACT, SHINGLES, Measure


def _bits(*sets):
    hashes = np.concatenate([np.unique(s) for s in sets])
    bounds = np.cumsum([0, *[len(np.unique(s)) for s in sets]])
    return jaccard_join._bitmaps(hashes, bounds)


def test_bitmaps_of_large_sets_show_large_differences(spark):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    sizes = [0, 3, 2048, 2049, 4096, 4097, 40_000]
    bits, folded = _bits(*[one[:n] for n in sizes])
    assert [64 * len(x) for x in bits.to_pylist()] == [2048, 2048, 2048, 4096, 4096, 8192, 65536]
    for i, longs in enumerate(bits.to_pylist()):  # the short form is the long one folded
        rows = np.array(longs).reshape(-1, 4)
        assert np.bitwise_xor.reduce(rows, axis=0).tolist() == [int(f[i].as_py()) for f in folded]
    other = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    a, b = _bits(one, other)[0].to_pylist()
    apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))
    assert apart > 2 * 40_000 * (100 - SHINGLES.percent) / (100 + SHINGLES.percent)


def test_bitmaps_of_two_lengths_are_compared(spark):
    rng = np.random.default_rng(4)
    one = np.unique(rng.integers(0, 1 << 63, 4200).astype(np.uint64))
    bits = _bits(one[:4000], one)[0].to_pylist()
    row = spark.createDataFrame([(*bits,)], "x array<long>, y array<long>")
    x, y = jaccard_join._as_short_as(F.col("x"), F.col("y")), jaccard_join._as_short_as(F.col("y"), F.col("x"))
    unlike = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    assert 0 < row.select(unlike).first()[0] <= 200
    assert (CONTRACT.foldings, SHINGLES.foldings, Measure(3, 40).foldings) == (1, 1, 2)


def test_large_near_copies_link(spark):
    """Sizes on both sides of a power of two, and unrelated texts that share a passage."""
    words = [f"w{i}" for i in range(4300)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, " ".join(words[:4050])), (2, " ".join(words)), (3, " ".join(words[300:]))]
    rows += [(10 + k, passage + " " + " ".join(f"u{k}x{i}" for i in range(4100 + k))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.linked(docs, CONTRACT).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 11, 12: 12, 13: 13}

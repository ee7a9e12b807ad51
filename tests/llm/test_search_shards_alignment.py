"""Lexical search, shards and token alignment against brute-force versions and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from askgrade.llm import alignment, lexical_search, sharding
from tests.llm.helpers import lower, prose, rows, same, table

ITEM_SCHEMA = "item_id long, text string, rank string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text or ""))


# --- 11
def plain_search(items, docs, top):
    """Every item against every document, in whole numbers."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        own = Counter(terms(text))
        found = []
        for place, (doc, c, n) in enumerate(held):
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, k in own.items() if t in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, place))
        found.sort()
        out += [(item, r + 1, None if f[1] else f[2], -f[0]) for r, f in enumerate(found[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(9)
    texts = [r[1] for r in rows() if r[1]]
    own = [(i, prose(rng, 12)) for i in range(30)]
    own += [(100, texts[3][:400]), (101, "the THE the"), (102, None), (103, ""), (104, "..."), (105, "zzzzunknown"), (100, "ä ß the"), (None, "of and")]
    return own


@pytest.mark.parametrize("top, block_terms, docs_in_tile", [(20, 1 << 16, 512), (3, 60, 5)])
def test_search_equals_brute_force(spark, items, monkeypatch, top, block_terms, docs_in_tile):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", min(512, block_terms))
    monkeypatch.setattr(lexical_search, "TILE_DOCS", docs_in_tile)
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEM_SCHEMA)
    got = lexical_search.search(asked, table(spark, clashing=True), top)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(items, [r[:2] for r in rows()], top)


def test_weights_beyond_2_to_the_53_are_dealt_to_layers():
    most = lexical_search.LAYER_WEIGHT
    own = [{0: 3 * most + 5, 1: 7}, {1: 2}]
    found = lexical_search.layers(own)
    total, by_layer = Counter(), Counter()
    for n, layer in enumerate(found):
        for item, term, weight in layer:
            total[item, term] += weight
            by_layer[n, item] += weight
    assert total == {(0, 0): 3 * most + 5, (0, 1): 7, (1, 1): 2} and max(by_layer.values()) <= most
    n = np.array([10**9, 3])
    assert lexical_search.impacts(np.array([2, 1]), n, 10**11, 10**12).tolist() == [
        2 * 10**9 // (2000 + 12 * (75 + 25 * int(x) * 10**11 // 10**12)) if i == 0 else 10**9 // (1000 + 12 * (75 + 25 * 3 * 10**11 // 10**12))
        for i, x in enumerate(n)
    ]


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = (prose(random.Random(1), 500) + " ÄÖ" * 50).encode()
    whole = [t for some in lexical_search.term_slices(text) for t in some]
    monkeypatch.setattr(lexical_search, "SLICE", 37)
    assert [t for some in lexical_search.term_slices(text) for t in some] == whole
    assert [t.decode() for t in whole] == terms(text.decode())


def test_search_in_empty_tables(spark, items):
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEM_SCHEMA)
    assert lexical_search.search(asked, table(spark, [])).collect() == []
    assert lexical_search.search(asked.limit(0), table(spark)).collect() == []


# --- 12
def check_shards(got, data, shards=16):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data
    )
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    return [sizes[s] for s in range(shards)]


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    rng = random.Random(3)
    data = [(i, prose(rng, rng.choice((1, 5, 40, 120))), "en", "a", 1) for i in range(1500)]
    data += [(2000 + i, data[7][1], "en", "a", 1) for i in range(40)]
    data += [(3000 + i, data[11][1] + " hot", "en", "hot", 1) for i in range(2500)]  # a group of over half of all rows
    data += [(None, "x", None, None, None)] * 3 + [(5, None, None, None, None), (6, "", None, None, None)]
    got = sharding.placed(table(spark, data)).collect()
    sizes = check_shards(got, data)
    assert max(sizes) <= 1.02 * min(sizes)
    shard_of = defaultdict(set)
    for r in got:
        shard_of[r.text_crc32].add(r.shard)
    hot = zlib.crc32((data[11][1] + " hot").encode())
    assert all(len(s) == 1 for crc, s in shard_of.items() if crc != hot) and len(shard_of[hot]) > 3


def test_shards_of_odd_tables(spark):
    assert sharding.placed(table(spark, [])).collect() == []
    for data in (rows(), rows()[:3], [(1, "a", None, None, 1)] * 50):
        check_shards(sharding.placed(table(spark, data, clashing=True)).collect(), data)


def test_splitters_find_ranges_of_keys_with_equal_digests():
    rng = random.Random(2)
    keys = [(rng.choice((-5, 0, 7, 9)), *rng.choice(((0, 0), (1, -3), (1, 4), (1, 8))), rng.randrange(6)) for _ in range(300)]
    for n in (0, 1, 3, 20):
        splitters = sharding.Splitters.of(rng.sample(keys, n) + [(7, -1, 0, 0)] * (n > 1))
        known = splitters.keys()
        got = splitters.find(*(np.array(c, np.int64) for c in zip(*keys)))
        assert got.tolist() == [sum(s <= k for s in known) for k in keys]


def test_written_shards_hold_every_row(spark, tmp_path):
    df = table(spark, clashing=True)
    sharding.write_shards(df, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert same(back.select(*df.columns), df) and back.select("shard").distinct().count() <= 4


# --- 13
def plain_alignment(data):
    own = alignment.Aligner()
    a_bytes, b_bytes = own.a_bytes.to_pylist(), own.b_bytes.to_pylist()
    docs = []
    for doc_id, text in data:
        a = own.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = own.b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            docs.append((doc_id, [], [], []))
            continue
        groups, i, j = [], 0, 0
        while i < len(a):
            x, y, p, q = len(a_bytes[a[i]]), len(b_bytes[b[j]]), i + 1, j + 1
            while x != y:
                if x < y:
                    x, p = x + len(a_bytes[a[p]]), p + 1
                else:
                    y, q = y + len(b_bytes[b[q]]), q + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        docs.append((doc_id, a, b, groups))
    counts = Counter()
    for _, _, _, groups in docs:
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append(
            (doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
             hashlib.sha256(text.encode()).hexdigest() if a else "")
        )
    return sorted(out, key=str)


ODD = ["it's'll x", "<|endoftext|> a<|endoftext|>", "</s> <s>▁x", "ﬁ ｘ ①", "a  b \n c", "  lead", "tail  ", " ", "\x00 \x01a", "東京 都", "\U0001f600\U0001f600 x",
       "x" * 3000 + " " + "ab" * 2000, "\t\tq\r\n", "a b c　d", "1234567 12.5%", "ÄÖÜ ß", "aaaa" * 700]


@pytest.mark.parametrize("entries, chars, links, big, slice_", [(1 << 21, 1 << 21, 1 << 21, 1 << 14, 1 << 20), (200, 500, 64, 6, 50)])
def test_alignment_equals_brute_force(spark, monkeypatch, entries, chars, links, big, slice_):
    for name, value in (("CHUNK_ENTRIES", entries), ("CHARS_AT_ONCE", chars), ("LINKS_AT_ONCE", links), ("BIG_GROUP", big), ("SLICE_CHARS", slice_)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n\té'.1東") for _ in range(80)) for _ in range(60)]
    data = rows()[:50] + [(1000 + i, t, None, None, 1) for i, t in enumerate(texts)]
    got = alignment.aligned(table(spark, data, clashing=True)).collect()
    assert sorted(map(tuple, got), key=str) == plain_alignment([r[:2] for r in data])


def test_small_limits_change_nothing_inside_a_task(monkeypatch):
    """The parameters above do not reach Python workers; here the aligner itself runs with them."""
    texts = ODD + [prose(random.Random(1), 300)]
    own = alignment.Aligner()
    whole = own.align(texts)
    for name, value in (("LINKS_AT_ONCE", 64), ("BIG_GROUP", 6), ("SLICE_CHARS", 50)):
        monkeypatch.setattr(alignment, name, value)
    parts = own.align(texts)
    for name in ("n_a", "n_b", "n_groups", "n_links", "doc", "pair", "times"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    assert whole.groups_sha256 == parts.groups_sha256


def test_runs_too_long_for_the_fast_library():
    own = alignment.Aligner()
    text = " " * 400_000
    assert own.encode_a(text).tolist() == own.a.encode(text, add_special_tokens=False).ids


def test_squeezed_numbers_come_back():
    for values in ([], [0], [1, 2**32 - 1, 70_000, 3]):
        assert alignment.restored(alignment.squeezed(np.array(values, np.int64))).tolist() == values


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(table(spark, [])).collect() == []

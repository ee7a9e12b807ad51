"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from askgrade import session
from askgrade.llm import (
    class_lm,
    common,
    exact_dedup,
    jaccard_join,
    licenses,
    line_templates,
    packing,
    range_coder,
    raking,
    rule_ensemble,
    spot_signatures,
    token_file,
)
from askgrade.llm.components import components
from askgrade.llm.common import numbered
from askgrade.llm.tokens import encoder
from tests.llm.helpers import lower, prose, rows, table, words


@pytest.fixture(scope="module")
def unique():
    """One row per id, none null."""
    return list({r[0]: r for r in rows() if r[0] is not None}.values())


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- helpers
def test_numbers_follow_the_order(spark):
    data = [(i, (i * 7919) % 101) for i in range(500)]
    df = spark.createDataFrame(data, "k int, v int").repartition(7)
    got = sorted((r.start, r.v, r.k) for r in numbered(df, ["v", "k"], "start", F.col("v")).collect())
    at = 0
    for start, v, _ in sorted(got, key=lambda x: (x[1], x[2])):
        assert start == at
        at += v


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


ODD = ["a.\nB,\nc", "x\n\ny z", "Ab AB ÄB äb.", "it's a'b. x_y __ 12ab b12 a1.","", "  a b", " a", "a  b \n c", "\n x y\n\n z ", "a  b　 c", "<|endoftext|> x<|endoftext|>", "\x01 \x01a \x02",
       "é x", " ́a", "it's 'll x 've", "a \x1c b", "\x85 x y", "x Ġ y Ġa", "   ", "a   ", "tab\t x"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(file):
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    plain.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + [prose(rng, 300)] + ["".join(rng.choice("ab \n\t\x01é'.1") for _ in range(60)) for _ in range(200)]
    for _ in range(2):
        got = [x.tolist() for x in encoder(file).encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


# --- 1
def test_spot_signatures(spark, unique):
    docs = sorted((r[0], r[1] or "") for r in unique)
    got = by_id(spot_signatures.compare_with_next(table(spark, unique)))
    sets = {d: set(got[d].fingerprint.split()) for d, _ in docs}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen = {}
    for i, (d, t) in enumerate(docs):
        after, text = docs[(i + 1) % len(docs)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + text[:cut]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(sets[d], set(r.edited_fingerprint.split())))
        assert r.near_next == pytest.approx(like(sets[d], sets[after]))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert bool(r.fingerprint) == bool(t.split())


def test_spot_chains(spark):
    df = spark.createDataFrame([("At the house of the old man",), ("the house old",), ("xyz abc",)], "t string")
    sets = [set(r.s) for r in spot_signatures.with_signatures(df, "t", "s").collect()]
    assert len(sets[0]) == 2  # the+house+old, the+old+man: of several anchors the last
    assert len(sets[0] & sets[1]) == 1 and len(sets[2]) == 1


def test_spot_join(spark, unique):
    members, pairs = spot_signatures.near_duplicates(table(spark, unique), 0.8)
    prints = by_id(spot_signatures.compare_with_next(table(spark, unique)))
    sets = {d: frozenset(r.fingerprint.split()) for d, r in prints.items()}
    classes = {}
    for d in sorted(sets):
        classes.setdefault(sets[d], d)
    assert {r.doc_id: r.class_id for r in members.collect()} == {d: classes[s] for d, s in sets.items()}
    wanted = set()
    for s, a in classes.items():
        for t, b in classes.items():
            if a < b and s and t and len(s & t) / len(s | t) >= 0.8:
                wanted.add((a, b))
    assert {(r.a, r.b) for r in pairs.collect()} == wanted and wanted


# --- 2
def test_raking_reaches_its_targets(spark):
    rng = random.Random(2)
    data = [(s, l, t, rng.randint(50, 5000)) for s in "abc" for l in "xy" for t in ("p", "q")]
    cells = spark.createDataFrame(data, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.9, "q": 0.1}}
    got = raking.raked(cells, targets, sweeps=30).collect()
    for dim, shares in targets.items():
        for value, share in shares.items():
            assert sum(r.weight for r in got if r[dim] == value) == pytest.approx(share, abs=1e-6)


def test_sample_has_the_calibrated_probabilities(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.randint(1, 30), rng.choice(("en", "de")), rng.choice("aaaaab"), 0) for i in range(4000)]
    got = raking.mixed_sample(table(spark, data)).collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(raking.KEEP * tokens, rel=1e-3)
    assert sum(r.n_tokens for r in got if r.sampled) == pytest.approx(raking.KEEP * tokens, rel=0.05)
    assert all(r.n_tokens == len(words(data[r.doc_id][1])) for r in got)
    share = Counter()
    for r in got:
        share[r.source] += r.n_tokens * r.probability
    before = sum(r.n_tokens for r in got if r.source == "b") / tokens
    assert share["b"] / sum(share.values()) > before


# --- 3
def test_best_fit_equals_the_plain_one():
    rng = np.random.default_rng(0)
    for capacity in (5, 16, 64):
        for _ in range(40):
            counts = np.bincount(rng.integers(1, capacity + 1, rng.integers(0, 200)), minlength=capacity + 1)
            runs = packing.best_fit(counts)
            gaps = []
            for size in range(capacity, 0, -1):
                for _ in range(counts[size]):
                    fits = [g for g in gaps if g >= size]
                    if fits:
                        gaps.remove(min(fits))
                    gaps.append((min(fits) if fits else capacity) - size)
            lengths = np.repeat(np.arange(capacity, 0, -1), counts[:0:-1])
            placed = defaultdict(list)
            for rank, length in enumerate(lengths):
                first, size, each, sequence, offset = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
                assert size == length
                placed[sequence + (rank - first) // each].append((offset + (rank - first) % each * size, length))
            assert len(placed) == len(gaps)
            for own in placed.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_packing(spark, unique):
    got = packing.packed(table(spark, unique)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {(r.doc_id, r.piece): r for r in got}
    total = 0
    for d, text, *_ in unique:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], "<u4")
            r = pieces.pop((d, piece))
            assert (r.start, r.length, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
            total += len(own)
    assert not pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(total / 2048) + 1


# --- 4
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_license_places(spark):
    rng = random.Random(6)
    pool = ["mit", "license", "apache", "general", "public", "gnu", "Ü", "x1", "cc", "by", "nc"]
    data = [(i, rng.choice((" ", "-", ", ")).join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 60))), None, None, None) for i in range(200)]
    got = by_id(licenses.scan(table(spark, data)))
    for d, text, *_ in data:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        starts = []
        for phrase, label in BASE.items():
            p = phrase.split()
            starts += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
        r = got[d]
        assert (r.n_words, r.n_base) == (len(own), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in starts}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions():
    parse, allowed = licenses.parse, licenses.permitted
    assert parse("MIT OR Apache-2.0 AND GPL-3.0-only") == ["MIT", "Apache-2.0", "GPL-3.0-only", "AND", "OR"]
    assert parse("(MIT OR GPL-2.0+) AND BSD-3-Clause") == ["MIT", "GPL-2.0+", "OR", "BSD-3-Clause", "AND"]
    assert parse("GPL-2.0-only WITH Classpath-exception-2.0 or MIT") == ["GPL-2.0-only", "Classpath-exception-2.0", "WITH", "MIT", "OR"]
    assert parse("MIT and then some") == ["MIT"] and parse("nothing here") == [] and parse("") == []
    assert parse("MIT.") == ["MIT"]
    assert allowed(parse("MIT OR GPL-3.0-only")) and not allowed(parse("MIT AND GPL-3.0-only"))
    assert not allowed(parse("CC-BY-NC-4.0")) and allowed(parse("CC-BY-4.0"))
    found = licenses.scan_text("// SPDX-License-Identifier: (MIT OR GPL-3.0-only)\nint x;")
    assert found["expressions"] == ["MIT GPL-3.0-only OR"] and found["permitted"] and found["score"] == 1
    assert found["labels"] == "gpl-3.0-only,mit"


def test_unknown_license_identifiers():
    parse, allowed = licenses.parse, licenses.permitted
    for name in ("CDDL-1.0", "EUPL-1.2", "Artistic-2.0", "OFL-1.1", "PSF-2.0", "0BSD", "WTFPL", "Ruby", "curl"):
        assert parse(name) == [name] and not allowed(parse(name))
        assert parse(f"{name} */\nint x;") == [name] and parse(f"MIT AND {name}") == ["MIT", name, "AND"]
        assert not allowed(parse(f"MIT AND {name}")) and allowed(parse(f"({name} OR MIT)"))
        assert parse(f"({name} OR MIT) AND ISC") == [name, "MIT", "OR", "ISC", "AND"]
    assert parse("MIT and CDDL-1.0") == ["MIT", "CDDL-1.0", "AND"]
    assert parse("MIT and (see the file)") == ["MIT"] and parse("see LICENSE") == parse("(see LICENSE)") == []
    assert parse("See the file") == [] and parse("MIT or Any later") == ["MIT"]
    found = licenses.scan_text("# SPDX-License-Identifier: MIT AND CDDL-1.0\nimport x")
    assert found["permitted"] is False and found["labels"] == "cddl-1.0,mit" and found["score"] == 1


# --- 5
def test_rules_separate_held_out_rows(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, 80)
        data.append((i, text if good else rng.choice((text.upper(), text.replace(" ", " | "), "spam " * 60)), None, None, None))
        labels.append((i, int(good)))
    got = rule_ensemble.classify(table(spark, data), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_statistics(spark):
    df = table(spark, [(1, "Ab  cd cd\n12 !!", None, None, None), (2, None, None, None, None)])
    a, b = [r["__llm_stats"] for r in rule_ensemble.with_statistics(df).orderBy("doc_id").collect()]
    assert (a.n_words, a.word_length, a.distinct_words, a.repeated_next) == (5, 2, 0.8, 0.2)
    assert (a.upper, a.digit, a.mark) == pytest.approx((1 / 15, 2 / 15, 2 / 15))
    assert (a.ends_in_mark, a.line_length) == (0.2, 7.5) and b.n_words == 0


def test_paths_become_rules():
    debug = "Tree 0 (weight 1.0):\n    If (feature 0 <= 2.0)\n     If (feature 1 > 1.5)\n      Predict: 1\n     Else (feature 1 <= 1.5)\n      Predict: 0\n    Else (feature 0 > 2.0)\n     Predict: 1"
    found = {r.tests for r in rule_ensemble.paths(debug)}
    n, w = rule_ensemble.STATISTICS[:2]
    assert ((n, False, 2.0),) in found and ((n, True, 2.0),) in found
    assert ((n, False, 2.0), (w, True, 1.5)) in found and len(found) == 4


# --- 6
def test_line_templates(spark):
    rng = random.Random(9)
    notice = "Page {} of the quarterly report by the board of the company"
    long_ = prose(rng, 60).replace("\n", " ")
    data = []
    for i in range(8):
        data.append((i, "\n".join([prose(rng, 40).replace("\n", " "), notice.format(i), long_, "ok ok"]), None, None, None))
    data += [(20, data[0][1], None, None, None), (21, "Page x of the quarterly report by the board of the company", None, None, None)]
    out = by_id(line_templates.without_recurring(table(spark, data)))
    for i in range(1, 8):
        assert out[i].text.split("\n") == [data[i][1].split("\n")[0], "ok ok"] and out[i].n_chars == len(out[i].text)
    assert out[0].text == data[0][1]  # the first keeps them
    assert len(out[20].text.split("\n")) == 2
    assert out[21].text == data[9][1]


def test_lines_of_two_texts(spark):
    """Two texts are enough for a passage, a wording with a variable and a line without spaces."""
    rng = random.Random(15)
    passage = prose(rng, 60).replace("\n", " ")
    asian = "東京は日本の首都であり人口は1400万人です"
    other = "東京は日本の首都であり人口は9300万人です"
    word = "report sent to a client {} on behalf of the whole team"
    data = [
        (1, f"{passage}\nalpha beta gamma\n{asian}", None, None, None),
        (2, f"delta beta gamma\n{passage}\n{asian}", None, None, None),
        (3, f"{other}\n" + word.format("ada"), None, None, None),
        (4, word.format("bob") + "\nok ok", None, None, None),
        (5, "ok ok\nthe only text with wording one of it all here now\nthe only text with wording two of it all here now", None, None, None),
        (6, "ok ok\nthe only text with wording one of it all here now\nthe only text with wording two of it all here now", None, None, None),
    ]
    out = by_id(line_templates.without_recurring(table(spark, data)))
    assert [out[i].text for i in (1, 3, 5, 6)] == [data[i - 1][1] for i in (1, 3, 5, 6)]
    assert (out[2].text, out[4].text) == ("delta beta gamma", "ok ok")


def test_texts_of_a_template_are_distinct(spark):
    """Lines with a word of their own in one text do not recur; with a second text they do, in two."""
    line = "written as usual by member {} for all the members of the board"
    data = [(1, "\n".join(line.format(x) for x in ("ada", "bob", "cyd")), None, None, None)]
    _, recurring = line_templates.templates(table(spark, data))
    assert recurring.count() == 0
    _, recurring = line_templates.templates(table(spark, [*data, (2, line.format("dan"), None, None, None)]))
    assert {r.texts for r in recurring.collect()} == {2}


def test_variable_tokens_without_digits(spark):
    data = [(i, f"report written for client {name} on behalf of the whole team", None, None, None) for i, name in enumerate("ada bob cyd dan".split())]
    out = by_id(line_templates.without_recurring(table(spark, data)))
    assert [out[i].text for i in range(4)] == [data[0][1], "", "", ""]


# --- 7
@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.zeros(n), rng.integers(0, 4, n) * 16383, np.minimum(rng.geometric(0.01, n), 65535)):
        ids = ids.astype(np.uint16)
        blocks, checks = range_coder.encode(ids)
        assert (range_coder.decode(blocks, checks, n) == ids).all()


def test_blocks_are_independent_compact_and_checked():
    ids = (np.arange(12_000) % 50 * 321).astype(np.uint16)
    blocks, checks = range_coder.encode(ids)
    assert sum(map(len, blocks)) < len(ids) // 4
    assert (range_coder.decode(blocks[1:2], checks[1:2], 4096) == ids[4096:8192]).all()
    broken = bytearray(blocks[0])
    broken[40] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode([bytes(broken)], checks[:1], 4096)


def test_token_file(spark, unique):
    got = by_id(token_file.round_trip(table(spark, unique)))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for d, text, *_ in sorted(unique):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# --- 8
def test_exact_duplicates(spark):
    data = rows()
    got = exact_dedup.exact_duplicates(table(spark, data)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[norm(t)].append((-len(t or ""), d is None, d if d is not None else 0, d))
    wanted = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert all(wanted[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    assert set(kept) == set(wanted) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_many_copies(spark):
    data = [(i, "same  text", None, None, None) for i in range(900)] + [(901, "same   text", None, None, None)]
    got = exact_dedup.exact_duplicates(table(spark, data)).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(901, 901)} and sum(r.kept for r in got) == 1


# --- 9
def _jaccard(data):
    sets = {}
    for d, text, *_ in data:
        w = words(text)
        sets[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_jaccard_join(spark, unique):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(table(spark, unique)).collect()}
    assert got == _jaccard(unique)


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_jaccard_join_of_frequent_shingles(spark, edits):
    """More near copies of one text than a rare shingle has, with links and without."""
    rng = random.Random(edits)
    base = prose(rng, 150).split()
    data = []
    for i in range(140):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(base)
        data.append((i, " ".join(own), None, None, None))
    shared = prose(rng, 60)
    data += [(1000 + i, shared + " " + prose(rng, 90), None, None, None) for i in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(table(spark, data)).collect()}
    assert got == _jaccard(data)


def test_jaccard_join_of_the_smallest_sets(spark):
    """Nine shingles within ten are a link, eight within nine are none."""
    data = []
    for k, n in enumerate((10, 11, 12)):
        own = [f"w{k}x{i}" for i in range(n)]
        data += [(10 * k, " ".join(own), None, None, None), (10 * k + 1, " ".join([*own, "end"]), None, None, None)]
        data.append((10 * k + 2, " ".join(["start", *own]), None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(table(spark, data)).collect()}
    assert got == _jaccard(data)
    assert [got[i][1] for i in (0, 1, 2, 10, 11, 12)] == [0, 1, 2, 10, 10, 10]


def _thue_morse(n: int, letters: str) -> str:
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_word_hashes_tell_regular_words_apart(monkeypatch):
    """Words whose polynomials modulo a power of two are equal for every base."""
    texts = [_thue_morse(n, ab) for n in (512, 1024, 2048, 4096) for ab in ("ab", "ba")] + ["A b", "a  B\n", "b a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, lengths, first = common.word_hashes(data, offsets)
    assert len(set(hashes[:8].tolist())) == 8 and lengths[:8].tolist() == [len(t) for t in texts[:8]]
    assert hashes[8] == hashes[10] == hashes[13] and hashes[9] == hashes[11] == hashes[12]
    assert first.tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14]
    monkeypatch.setattr(common, "_ADDABLE", 1)  # as for very long texts
    assert common.word_hashes(data, offsets)[0].tolist() == hashes.tolist()


def test_jaccard_join_of_regular_words(spark):
    data = [(i, _thue_morse(4096, ab), None, None, None) for i, ab in enumerate(("ab", "ba", "ab"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(table(spark, data)).collect()}
    assert got == _jaccard(data) == {0: (1, 0), 1: (1, 1), 2: (1, 0)}


def test_jaccard_join_leaves_its_result_only(spark, unique, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    jaccard_join.linked(table(spark, unique)).count()
    assert [f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()] == ["jaccard-result"]


def _components_by(data, k, percent):
    """Components by shingles of ``k`` words, every pair compared."""
    sets = {}
    for d, text, *_ in data:
        w = words(text)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def _near_copies():
    """Copies of a text with few to many edits, frequent shingles, and the smallest sets."""
    rng = random.Random(14)
    data = []
    for n in (30, 90, 150):
        base = prose(rng, n).split()
        for _ in range(50):
            own = list(base)
            for _ in range(rng.randint(0, n // 15)):
                own[rng.randrange(len(own))] = rng.choice(base)
            own = own[rng.randint(0, n // 12) :]
            data.append((len(data), " ".join(own), None, None, None))
    for k, n in enumerate((6, 7, 8, 9, 10)):
        own = [f"w{k}x{i}" for i in range(n)]
        for text in (own, [*own, "end"], ["start", *own]):
            data.append((len(data), " ".join(text), None, None, None))
    return data


@pytest.mark.parametrize("k, percent", [(5, 80), (3, 90)])
def test_jaccard_join_by_measure(spark, k, percent):
    data = _near_copies()
    found = jaccard_join.linked(table(spark, data), jaccard_join.Measure(k, percent))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == _components_by(data, k, percent)


def test_pipeline_drops_copies_by_five_words(spark):
    """Many of these are copies by 5 words and 0.8 but not by 3 words and 0.9."""
    data = _near_copies()
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    kept = {r.doc_id for r in stage(spark, table(spark, data), "").collect()}
    wanted = {d for d, (_, top) in _components_by(data, 5, 80).items() if d == top}
    assert kept == wanted and len(wanted) < len({top for _, top in _components_by(data, 3, 90).values()})


# --- 10
def test_class_lm_base(spark, unique):
    got = by_id(class_lm.scored(table(spark, unique)))
    counts = Counter()
    for d, text, *_ in unique:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    for d, text, *_ in unique:
        own = [*words(text), None]
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))


def test_rare_words_are_joined(spark, unique, monkeypatch):
    whole = by_id(class_lm.scored(table(spark, unique)))
    monkeypatch.setattr(class_lm, "HEAVY", 50)
    part = by_id(class_lm.scored(table(spark, unique)))
    for d, r in whole.items():
        assert (part[d].n_known, part[d].n_tokens) == (r.n_known, r.n_tokens)
        assert part[d].base_score == pytest.approx(r.base_score)


def test_classes_lower_the_perplexity(spark):
    """Two languages that never mix: classes know which one a text is in."""
    rng = random.Random(3)
    vocabulary = [["".join(rng.choice(letters) for _ in range(4)) for _ in range(80)] for letters in ("abcd", "wxyz")]
    data = [(i, " ".join(rng.choice(vocabulary[i % 2]) for _ in range(100)), None, None, None) for i in range(200)]
    got = class_lm.scored(table(spark, data)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    group = np.arange(30) % 3
    table_ = rng.poisson(1 + 30 * (group[:, None] == (group[None] + 1) % 3)).astype(float)
    counts = np.zeros((31, 31))
    counts[:30, :30] = table_
    of = class_lm.exchange(counts, 30, classes=3, sweeps=10)
    assert all(len(set(of[:30][group == g])) == 1 for g in range(3)) and len(set(of[:30])) == 3


def test_words_outside_the_core_get_classes(spark, monkeypatch):
    """Two languages of 1,500 words that never mix and a small core: the batches part them."""
    monkeypatch.setattr(class_lm, "CORE", 60)
    rng = random.Random(5)
    vocabulary = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(1500)] for letters in ("abcd", "wxyz")]
    data = [
        (i, " ".join(vocabulary[i % 2][int(1500 * rng.random() ** 2)] for _ in range(200)), None, None, None)
        for i in range(400)
    ]
    texts = table(spark, data)
    model, *_ = class_lm.train(texts.where(~class_lm.held_out(texts.doc_id)))
    known = model.vocabulary
    assert len(known.words) > 1500 and known.units == 60
    assert (known.of < known.classes).mean() > 0.99
    with_classes = class_lm.scored(texts).where("held_out").collect()
    monkeypatch.setattr(class_lm, "ROUNDS", 0)
    core_only = class_lm.scored(texts).where("held_out").collect()
    tokens = sum(r.n_tokens for r in with_classes)
    assert sum(r.score for r in with_classes) > sum(r.score for r in core_only) + 0.05 * tokens
    assert sum(r.score for r in with_classes) > sum(r.base_score for r in with_classes) + 0.25 * tokens


def test_batches_take_the_best_class():
    """Against plain sums of the criterion: what a class wins with the word, less what the word's own would lose."""
    rng = np.random.default_rng(2)
    classes, size, words_ = 4, 6, 40
    table_ = rng.poisson(300, (size, size)).astype(float)
    old = rng.integers(0, 5, words_)  # class 4 is one of lengths: a word may only leave it
    found = rng.poisson(3, (words_, 2 * size)) * (rng.random((words_, 2 * size)) < 0.5)
    found[:, 0] += 1
    found = np.minimum(found, 100)

    def g(x):
        return x * math.log(x) if x > 0 else 0.0

    wanted = []
    for w in range(words_):
        value = {}
        for k in {*range(classes), int(old[w])}:
            sign = -1 if k == old[w] else 1
            value[k] = 0.0
            for j in range(size):
                for n, cell in ((found[w, j], table_[k, j]), (found[w, size + j], table_[j, k])):
                    value[k] += sign * (g(cell + sign * n) - g(cell))
            for n, total in ((found[w, :size].sum(), table_[k].sum()), (found[w, size:].sum(), table_[:, k].sum())):
                value[k] -= sign * (g(total + sign * n) - g(total))
        wanted.append(max(value, key=lambda k: (value[k], k == old[w])))
    owner, slots = np.nonzero(found)
    starts = np.searchsorted(owner, np.arange(words_))
    new = class_lm.best_classes(table_, classes, old, starts, slots, found[owner, slots])
    assert list(new) == wanted and any(new != old)


def test_vocabulary_is_bounded_and_grows(spark, monkeypatch):
    counts = spark.createDataFrame([(8 * i + 8, 1 + i % 40) for i in range(400)], "word long, n long")
    whole = counts.where(class_lm.frequent(counts)).count()
    assert whole == counts.where(f"n >= {class_lm.LEAST}").count()
    monkeypatch.setattr(class_lm, "HEAVY", 100)
    kept = counts.where(class_lm.frequent(counts))
    assert 0 < kept.count() <= 100
    assert kept.agg({"n": "min"}).first()[0] > counts.subtract(kept).agg({"n": "max"}).first()[0]


# --- the pipeline against plain versions of its stages
def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    rng = random.Random(12)
    boiler = "This line stands in many documents and says nothing at all"
    data = []
    for i in range(60):
        text = prose(rng, 120)
        if i % 5 == 4:
            text = text.upper()
        elif i % 3 == 0:
            text = boiler + "\n" + text
        data.append((i, text, "en", "a" if i % 2 else "b", len(text)))
    near = data[1][1].split(" ")
    near[10] = "changed"
    data.append((100, " ".join(near), "en", "a", 0))
    path = str(tmp_path)
    table(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] % 5 != 4)) for d in data], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, path)
    assert {r.doc_id for r in good.collect()} == {d[0] for d in data if d[0] % 5 != 4 or d[0] == 100}
    cut = by_id(stages["line dedup"](spark, good, path))
    assert [d for d, r in sorted(cut.items()) if boiler in r.text] == [0]
    single = stages["n-gram Jaccard join"](spark, good, path)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in good.collect()} - {100}
    mixed = stages["mixing sources to target weights"](spark, single, path)
    sampled = {r.doc_id for r in raking.mixed_sample(single).where("sampled").collect()}
    assert {r.doc_id for r in mixed.collect()} == sampled
    packed = stages["best-fit packing"](spark, mixed, path)
    assert {r.doc_id for r in packed.collect()} == sampled

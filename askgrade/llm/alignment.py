"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level BPE vocabulary, B a sentence-piece model with byte fallback. Texts are encoded and
aligned a batch at a time with whole arrays: where a token of A and one of B end at the same byte, a
group ends. Groups give links, a document's links its distinct pairs of ids.

* Identity map: for every A id, the B id with the same bytes. Pairs of the map, as in a group of
  exactly these two, are counted in a vector as long as A's vocabulary; only the other pairs, of
  irregular groups, go into the shuffle of pairs.
* Documents are handled in chunks. A chunk is one row: its distinct pairs with the number of
  documents that hold them, and for each document which of them it holds. So the shuffle of pairs
  has a row for a chunk and pair, not for a document and pair, and a pair that occurs in every
  document is no hot key. Corpus-wide counts come back to the chunk's pairs by a join, and a
  document's sums are sums over its pairs.
* What goes to every task is bounded by A's vocabulary: the vector of the identity map's counts and
  the highest count of every A id.

Very long texts are encoded in slices that end before a single space between two other characters,
across which no token reaches; a run without such a place is encoded as one, so memory grows with
the longest of these. Links are counted a bounded number at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import arrow_batches, whole_texts
from askgrade.session import discard, materialise

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: A chunk ends when its documents hold so many distinct pairs in all.
CHUNK_ENTRIES = 1 << 21
#: Characters aligned at once (a longer text is aligned alone), and encoded at once.
CHARS_AT_ONCE = 1 << 21
SLICE_CHARS = 1 << 20
LINKS_AT_ONCE = 1 << 21
#: Links of a group from which its ids are counted before they are paired.
BIG_GROUP = 1 << 14
_CUT = re.compile(r"(?<=\S)(?= \S)")
_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, sizes binary, held binary, times binary, pairs binary, "
    "same_ids array<int>, same_docs array<int>, odd_pairs array<long>, odd_docs array<int>"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_level_bytes() -> dict[str, int]:
    """The public byte-level alphabet: the byte of each character that vocabularies are written in."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def slices(text: str) -> Iterator[str]:
    """A text in slices of about SLICE_CHARS; every one but the first begins with the space it is cut at."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE_CHARS:
            cut = _CUT.search(text, at + SLICE_CHARS)
            end = cut.start() if cut else end
        yield text[at:end]
        at = end


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts`` and are ``sizes`` long, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def summed(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit integers by ascending group number."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.searchsorted(group, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed planes of bytes (most are small)."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def restored(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


@dataclass
class Links:
    """Aligned texts: numbers by document, and distinct (document, pair) keys with their times."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]
    doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Encodes and aligns texts; a pair of ids is one number, ``a * b_ids + b``."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.b_ids = self.b.get_piece_size()
        byte_of = byte_level_bytes()
        a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in self.a.get_vocab().items():
            if token in special:
                a_bytes[i] = token.encode()
            else:
                a_bytes[i] = bytes(byte_of[c] for c in token)
                ranks[a_bytes[i]] = i  # ids follow the order of the merges
        # the same vocabulary in a library that is faster on distinct words
        self.ordinary = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        b_bytes = [self._b_bytes(i) for i in range(self.b_ids)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_sizes = np.array([len(x) for x in a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in b_bytes], np.int64)
        # of entries with the same bytes a piece is preferred to a single byte, then the smallest id
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(self.b_ids), key=lambda i: (self.b.is_byte(i), i)):
            by_bytes.setdefault(b_bytes[i], i)
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)
        # pieces of B with a space inside would reach across a cut
        self.cuts = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b_ids))
        ends = [f"{i}{mark}" for mark in ",|;" for i in range(1 << 16)]
        self.shown = pa.array(ends, pa.large_string())

    def _b_bytes(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of A for a text that begins with a space."""
        found = []
        for part in slices(text):
            try:
                found.append(self.ordinary.encode_to_numpy(part, disallowed_special=()))
            except ValueError:  # too long a run for its pattern
                found.append(np.array(self.a.encode(part, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(found).astype(np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of B for texts that begin with a space, which B adds itself."""
        parts = [list(slices(t)) if self.cuts else [t] for t in texts]
        ids = iter(self.b.encode([p[1:] for own in parts for p in own], num_threads=1))
        return [np.concatenate([np.array(next(ids), np.int64) for _ in own]) for own in parts]

    def align(self, texts: list[str]) -> Links:
        n = len(texts)
        rows = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in rows]
        a, b = [self.encode_a(t) for t in spaced], self.encode_b(spaced)
        whole = [t.encode() for t in spaced]
        good = [i for i in range(len(rows)) if _bytes(self.a_bytes, a[i]) == whole[i] == _bytes(self.b_bytes, b[i])]
        doc = np.array([rows[i] for i in good], np.int64)
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_a[doc], n_b[doc] = [len(a[i]) for i in good], [len(b[i]) for i in good]
        nothing = [np.zeros(0, np.int64)]
        a_ids, b_ids = np.concatenate(nothing + [a[i] for i in good]), np.concatenate(nothing + [b[i] for i in good])
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        mark = np.zeros((a_ends[-1] if len(a_ends) else 0) + 1, np.int8)
        mark[a_ends] = 1
        mark[b_ends] += 2  # no token is empty, so ends are distinct
        a_last, b_last = mark[a_ends] == 3, mark[b_ends] == 3
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        of_a, of_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        group_doc = np.repeat(np.arange(n), n_a)[a_last]
        pair_keys, times = self._pairs(a_ids, b_ids, of_a, of_b, group_doc)
        width = len(self.a_sizes) * self.b_ids
        return Links(
            n_a, n_b, np.bincount(group_doc, minlength=n), summed(group_doc, of_a * of_b, n),
            self._digests(a_ids, b_ids, a_last, b_last, a_group, b_group, of_a, of_b, n_a + n_b),
            pair_keys // width, pair_keys % width, times,
        )

    def _digests(self, a_ids, b_ids, a_last, b_last, a_group, b_group, of_a, of_b, sizes) -> list[str]:
        """SHA-256 of the groups written out: a group's A ids, then its B ids."""
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        codes[np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[a_group]] = a_ids + np.where(a_last, 1 << 16, 0)
        codes[np.arange(len(b_ids)) + np.cumsum(of_a)[b_group]] = b_ids + np.where(b_last, 2 << 16, 0)
        written = self.shown.take(pa.array(codes))
        ends = np.frombuffer(written.buffers()[1], np.int64)[: len(codes) + 1]
        data = memoryview(written.buffers()[2] or b"")
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]

    def _pairs(self, a_ids, b_ids, of_a, of_b, group_doc) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, a, b) keys with how many links they stand for."""
        links = of_a * of_b
        a_start, b_start = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        base = group_doc * len(self.a_sizes)
        normal = np.flatnonzero(links < BIG_GROUP)
        passed = np.cumsum(links[normal])
        at = 0
        while at < len(normal):
            before = passed[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(passed, before + LINKS_AT_ONCE)))
            own = normal[at:end]
            left = spread(a_start[own], of_a[own])  # A tokens of the groups
            right = np.repeat(of_b[own], of_a[own])  # B tokens that each is linked with
            first = np.repeat(b_start[own], of_a[own])
            key = (np.repeat(base[own], of_a[own]) + a_ids[left]) * self.b_ids
            key = np.repeat(key, right) + b_ids[spread(first, right)]
            found, n = np.unique(key, return_counts=True)
            keys.append(found)
            times.append(n)
            at = end
        for g in np.flatnonzero(links >= BIG_GROUP).tolist():
            x, m = np.unique(a_ids[a_start[g] : a_start[g] + of_a[g]], return_counts=True)
            y, k = np.unique(b_ids[b_start[g] : b_start[g] + of_b[g]], return_counts=True)
            keys.append((((base[g] + x) * self.b_ids)[:, None] + y).ravel())
            times.append((m[:, None] * k).ravel())
        return counted(np.concatenate(keys), np.concatenate(times))


def _bytes(table: pa.Array, ids: np.ndarray) -> bytes:
    taken = table.take(pa.array(ids))
    data = taken.buffers()[2]
    return data.to_pybytes() if data is not None else b""


class Chunk:
    """Documents of a chunk with the pairs they hold."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.links: list[Links] = []
        self.size = 0

    def add(self, doc_ids: list[int | None], links: Links) -> None:
        self.doc_ids += doc_ids
        self.links.append(links)
        self.size += len(links.pair)

    def row(self, number: int, aligner: Aligner) -> pa.RecordBatch:
        every = np.concatenate([x.pair for x in self.links])
        sizes = np.concatenate([np.bincount(x.doc, minlength=len(x.n_a)) for x in self.links])
        pairs, place = np.unique(every, return_inverse=True)
        docs = np.bincount(place, minlength=len(pairs))  # a document holds a pair once
        a, b = np.divmod(pairs, aligner.b_ids)
        regular = aligner.same[a] == b
        vector = np.zeros(len(aligner.same), np.int64)  # as long as the vocabulary
        vector[a[regular]] = docs[regular]
        ids = np.flatnonzero(vector)
        numbers = [np.concatenate([getattr(x, c) for x in self.links]) for c in ("n_a", "n_b", "n_groups", "n_links")]
        digests = [d for x in self.links for d in x.groups_sha256]
        steps = np.diff(place, prepend=0)  # ascending within a document
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[firsts] = place[firsts]
        blobs = [squeezed(sizes), squeezed(steps), squeezed(np.concatenate([x.times for x in self.links])), squeezed(np.diff(pairs, prepend=0))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())),
                *(pa.array([x], pa.list_(pa.int64())) for x in numbers), pa.array([digests], pa.list_(pa.string())),
                *(pa.array([x], pa.binary()) for x in blobs),
                pa.array([ids], pa.list_(pa.int32())), pa.array([vector[ids]], pa.list_(pa.int32())),
                pa.array([pairs[~regular]], pa.list_(pa.int64())), pa.array([docs[~regular]], pa.list_(pa.int32())),
            ],
            [c.split()[0] for c in _CHUNK.split(", ")],
        )


def _some(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHARS_AT_ONCE characters (one row at least)."""
    at = chars = 0
    for i, text in enumerate(texts):
        if i > at and chars + len(text) > CHARS_AT_ONCE:
            yield at, i
            at, chars = i, 0
        chars += len(text)
    if at < len(texts):
        yield at, len(texts)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    aligner, chunk = Aligner(), Chunk()
    for batch in batches:
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for at, end in _some(texts):
            chunk.add(doc_ids[at:end], aligner.align(texts[at:end]))
            if chunk.size >= CHUNK_ENTRIES:
                yield chunk.row((part << 32) + number, aligner)
                chunk, number = Chunk(), number + 1
    if chunk.doc_ids:
        yield chunk.row((part << 32) + number, aligner)


def _answers(shared):
    """Documents of a chunk with the corpus-wide counts of its pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, b_ids, vector, highest = shared.value
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                value = lambda c: row.column(c)[0]
                ints = lambda c: restored(value(c).as_py())
                pairs = np.cumsum(ints("pairs"))
                a, b = np.divmod(pairs, b_ids)
                count = np.where(same[a] == b, vector[a], 0)
                if value("counts").is_valid:
                    found = value("counts").values
                    count[np.searchsorted(pairs, found.field("pair").to_numpy())] = found.field("docs").to_numpy()
                sizes, steps, times = ints("sizes"), ints("held"), ints("times")
                doc = np.repeat(np.arange(len(sizes)), sizes)
                passed = np.cumsum(steps)
                before = np.concatenate([[0], passed])[np.cumsum(sizes) - sizes]
                held = passed - before[doc]
                made = {
                    "n_best": pa.array(summed(doc, times * (count == highest[a])[held], len(sizes))),
                    "count_sum": pa.array(summed(doc, times * count[held], len(sizes))),
                }
                names = [c.split()[0] for c in _RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([made[c] if c in made else value(c).values for c in names], names)

    return run


def aligned(documents: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A null or empty text, and one whose bytes a tokenizer does not keep, has zeros and an empty
    ``groups_sha256``. Every row is a document: repeated rows count as often as they occur. An
    empty table gives an empty result; other columns are left behind.
    """
    spark = documents.sparkSession
    with arrow_batches(spark, 2000):
        chunks = materialise(whole_texts(documents).mapInArrow(_chunks, _CHUNK), "aligned-chunks")
    same = chunks.select(F.inline(F.arrays_zip("same_ids", "same_docs")).alias("a", "docs"))
    same = same.groupBy("a").agg(F.sum("docs").alias("docs"))
    odd = chunks.select("chunk", F.inline(F.arrays_zip("odd_pairs", "odd_docs")).alias("pair", "docs"))
    counts = materialise(odd.groupBy("pair").agg(F.sum("docs").alias("docs")), "aligned-counts")
    aligner = Aligner()
    a = F.floor(F.col("pair") / aligner.b_ids).cast("int").alias("a")
    highest = counts.groupBy(a).agg(F.max("docs").alias("docs"))
    vector, best = np.zeros(len(aligner.same), np.int64), np.zeros(len(aligner.same), np.int64)
    for table, into in ((same, vector), (highest, best)):  # a row for an A id at most
        for r in table.toLocalIterator():
            into[r["a"]] = r["docs"]
    shared = spark.sparkContext.broadcast((aligner.same, aligner.b_ids, vector, np.maximum(vector, best)))
    back = odd.select("chunk", "pair").join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "docs")).alias("counts"))
    with arrow_batches(spark, 1):
        out = materialise(chunks.join(back, "chunk", "left").mapInArrow(_answers(shared), _RESULT), "aligned")
    for table in (chunks, counts):
        discard(table)
    return out

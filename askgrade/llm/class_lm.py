"""Language-model scores from a class-based bigram model.

    P(word | previous word) = P(class | class of the previous word) * P(word | class)

* Exchange clustering in two steps. The ``CORE`` most frequent words are exchanged one after the
  other on their neighbour counts: each moves to the class that raises the likelihood most.
  Then all words of the vocabulary, those that occur ``LEAST`` times or more, are exchanged in
  ``ROUNDS`` batches: Spark adds up how often each word stands before and after every class, and
  a task moves each of its words to its best class against the same table of classes. So the
  clustered words grow with the corpus. A batch that lowers the likelihood is taken back.
* Words below ``LEAST`` belong to classes by their length, which needs no table. The start and
  the end of a text are one more class.
* Word counts cover all training texts. The vocabulary (at most ``HEAVY`` words, the most
  frequent ones) is sent to every task; the counts of all other words are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import arrow_batches, small_batches, text_slices, whole_texts, word_hashes
from askgrade.session import discard, materialise

CORE = 1000
LEAST = 8
ROUNDS = 2
CLASSES = 48
SWEEPS = 8
HEAVY = 1 << 21
LENGTH_CLASSES = np.array([0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5])  # by bytes; longer ones: the last
N_LENGTHS = 6
END = 1  # stands for the end of a text among the hashes of words
BETA = 5.0
ALPHA = 0.5
FOLD = 1 << 21


def held_out(doc_id: Column) -> Column:
    """A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _length_class(lengths: np.ndarray) -> np.ndarray:
    return LENGTH_CLASSES[np.minimum(lengths, len(LENGTH_CLASSES) - 1)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, kind, n`` of a partition; the key holds the length class in its lowest bits."""
    keys, counts, waiting, ends = [], [], 0, 0
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            hashes, lengths, _ = word_hashes(data, offsets)
            ends += hi - lo
            k, n = np.unique(_key(hashes, lengths), return_counts=True)
            keys.append(k)
            counts.append(n)
            waiting += len(k)
            if waiting > FOLD and len(keys) > 1:
                k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [k], [n]
                if len(k) > FOLD:
                    yield _word_rows(k, n)
                    keys, counts = [], []
                waiting = 0
    if keys:
        yield _word_rows(*_summed(np.concatenate(keys), np.concatenate(counts)))
    if ends:
        yield _word_rows(np.array([END], np.uint64), np.array([ends]))


def _key(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """61 bits of a word's hash and its length class."""
    return (hashes & ~np.uint64(7)) | _length_class(lengths).astype(np.uint64)


def _word_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` of all texts (one row per distinct word, and END)."""
    counted = small_batches(texts.select("text")).mapInArrow(_count_words, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _step(n: Column) -> Column:
    """Counts on a logarithmic scale."""
    return F.floor(F.log2(n) * 4).cast("int")


def frequent(words: DataFrame) -> Column:
    """Whether a row of ``word, n`` is in the vocabulary: ``n`` is at least LEAST, and at most HEAVY
    words reach its step of the scale."""
    is_word = (F.col("n") >= LEAST) & (F.col("word") != END)
    steps = words.where(is_word).groupBy(_step(F.col("n")).alias("step")).agg(F.count("*").alias("words"))
    lowest, room = None, HEAVY
    for row in sorted(steps.collect(), reverse=True):  # at most 4 * 64 rows
        room -= row["words"]
        if room < 0:
            break
        lowest = row["step"]
    return is_word & (_step(F.col("n")) >= lowest) if lowest is not None else F.lit(False)


class Vocabulary:
    """Frequent words sorted by key, with counts and classes. The first ``units`` by frequency are
    the core; ``core`` has their ranks (-1 for the others)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.core = np.full(len(words), -1, np.int32)
        top = np.lexsort((self.words, -self.counts))[:CORE]
        self.core[top] = np.arange(len(top))
        self.units = len(top)
        self.kinds = (self.words & np.uint64(7)).astype(np.int16)
        self.classes, self.of = 0, None

    def classify(self, of: np.ndarray) -> None:
        """``of`` has the classes of the core, then those of the lengths and of the boundary."""
        self.classes = int(of[-1]) - N_LENGTHS
        self.of = np.where(self.core >= 0, of[np.maximum(self.core, 0)], self.classes + self.kinds).astype(np.int16)

    @property
    def size(self) -> int:
        """Classes, lengths and the boundary."""
        return self.classes + N_LENGTHS + 1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are in the vocabulary, and where."""
        if not len(self.words):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return self.words[place] == keys, place

    def core_units(self, keys: np.ndarray) -> np.ndarray:
        """Units of the core; other words' units follow by length."""
        tail = self.units + (keys & np.uint64(7)).astype(np.int64)
        known, place = self.places(keys)
        if not len(self.words):
            return tail
        return np.where(known & (self.core[place] >= 0), self.core[place], tail)

    def class_of(self, keys: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
        tail = self.classes + (keys & np.uint64(7)).astype(np.int64)
        return np.where(known, self.of[place], tail) if len(self.words) else tail


def _sequences(units: np.ndarray, first: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous and own unit of every token, the end of each text included."""
    n = len(first) - 1
    own = np.insert(units, first[1:], boundary)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first[:-1] + np.arange(n)] = boundary
    return before, own


def _count_neighbours(shared) -> Callable:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = vocabulary.units + N_LENGTHS + 1
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                hashes, lengths, first = word_hashes(data, offsets)
                before, own = _sequences(vocabulary.core_units(_key(hashes, lengths)), first, size - 1)
                total += np.bincount(before * size + own, minlength=size * size)
        pairs = np.flatnonzero(total)
        yield _word_rows(pairs.astype(np.uint64), total[pairs])

    return count


def exchange(counts: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. ``counts`` has how often a unit (row) precedes another; the first
    ``movable`` units are clustered into ``classes``, each later one is a class of its own."""
    classes = min(classes, max(movable, 1))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(len(counts) - movable)])
    size = classes + len(counts) - movable
    member = np.zeros((len(counts), size))
    member[np.arange(len(counts)), of] = 1
    rows, columns = counts @ member, counts.T @ member  # neighbours' classes of every unit
    table = member.T @ rows

    f = _f
    for _ in range(sweeps):
        moved = 0
        for unit in range(movable):
            old, own = of[unit], counts[unit, unit]
            after, before = rows[unit].copy(), columns[unit].copy()
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            k = np.arange(classes)
            here = table[:classes]
            gain = f(here + after) - f(here)
            gain[k, k] = 0
            there = table[:, :classes].T
            gain2 = f(there + before) - f(there)
            gain2[k, k] = 0
            middle = table[k, k]
            total = gain.sum(1) + gain2.sum(1) + f(middle + after[:classes] + before[:classes] + own) - f(middle)
            sums, sums2 = here.sum(1), there.sum(1)
            total -= f(sums + after.sum() + own) - f(sums)
            total -= f(sums2 + before.sum() + own) - f(sums2)
            new = int(np.argmax(total))
            if total[new] <= total[old] + 1e-9:
                new = old
            table[new] += after
            table[:, new] += before
            table[new, new] += own
            if new != old:
                moved += 1
                of[unit] = new
                rows[:, old] -= counts[:, unit]
                rows[:, new] += counts[:, unit]
                columns[:, old] -= counts[unit]
                columns[:, new] += counts[unit]
        if not moved:
            break
    return of


def _contexts(shared) -> Callable:
    """``word, slot, n``: how often a word of the vocabulary outside the core stands before a class
    (slot: the class) and after one (slot: ``size`` and the class). Pairs of classes of all tokens
    have the words -1, -2, ..."""

    def rows(size: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array((keys // (2 * size)).astype(np.int32)), pa.array((keys % (2 * size)).astype(np.int32)), pa.array(counts)],
            ["word", "slot", "n"],
        )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = vocabulary.size
        table = np.zeros(size * size, np.int64)
        keys, counts, waiting = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                hashes, lengths, first = word_hashes(data, offsets)
                key = _key(hashes, lengths)
                known, place = vocabulary.places(key)
                before, own = _sequences(vocabulary.class_of(key, known, place), first, size - 1)
                table += np.bincount(before * size + own, minlength=size * size)
                at = np.flatnonzero(known)
                at = at[vocabulary.core[place[at]] < 0]
                token = at + np.searchsorted(first[1:], at, "right")  # its place among words and ends
                word = place[at] * (2 * size)
                k, n = np.unique(np.concatenate([word + own[token + 1], word + size + before[token]]), return_counts=True)
                keys.append(k)
                counts.append(n)
                waiting += len(k)
                if waiting > FOLD:
                    k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, waiting = [k], [n], len(k)
                    if len(k) > FOLD // 2:
                        yield rows(size, k, n)
                        keys, counts, waiting = [], [], 0
        if keys:
            yield rows(size, *_summed(np.concatenate(keys), np.concatenate(counts)))
        pairs = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array((-1 - pairs).astype(np.int32)), pa.array(np.zeros(len(pairs), np.int32)), pa.array(table[pairs])],
            ["word", "slot", "n"],
        )

    return count


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the training likelihood that depends on the classes; ``table`` has how often a
    class precedes another."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def best_classes(table, classes, old, starts, slots, n) -> np.ndarray:
    """The best class of every word by the exchange criterion, all against the same ``table``.

    Word ``i`` is in class ``old[i]`` and has the entries from ``starts[i]`` on: ``n`` times in a slot,
    as ``_contexts`` has them. It goes to one of the first ``classes`` or stays; its pairs with words
    that move at the same time are taken as they are.
    """
    size = len(table)
    base = np.concatenate([table.T, table])  # slot, class
    totals = np.stack([table.sum(1), table.sum(0)])
    owner = np.repeat(np.arange(len(old)), np.diff(np.append(starts, len(slots))))
    n = n.astype(float)
    there = base[:, :classes]
    gain = np.add.reduceat(_f(there[slots] + n[:, None]) - _f(there)[slots], starts, axis=0)
    own = base[slots, old[owner]]
    stay = np.add.reduceat(_f(own) - _f(np.maximum(own - n, 0)), starts)
    for side in (0, 1):
        amount = np.bincount(owner, n * ((slots >= size) == side), len(old))
        total = totals[side]
        gain -= _f(total[:classes] + amount[:, None]) - _f(total[:classes])
        stay -= _f(total[old]) - _f(np.maximum(total[old] - amount, 0))
    inside = np.flatnonzero(old < classes)
    gain[inside, old[inside]] = stay[inside]
    best = gain.argmax(1)
    return np.where(gain[np.arange(len(old)), best] > stay + 1e-9, best, old)


def _move(shared) -> Callable:
    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, classes, of = shared.value
        for batch in batches:
            word, found = np.asarray(batch.column("word")), batch.column("found")
            if not len(word):
                continue
            entries = found.flatten()
            slots, n = (np.asarray(entries.field(x)) for x in (0, 1))
            starts = np.cumsum(np.asarray(found.value_lengths())) - np.asarray(found.value_lengths())
            new = best_classes(table, classes, of[word].astype(np.int64), starts, slots, n)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(new.astype(np.int16))], ["word", "class"])

    return move


def _in_contexts(texts: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, np.ndarray]:
    """The words' contexts (``word, found``) as a table, and the pairs of classes."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    counted = (
        small_batches(texts.select("text")).mapInArrow(_contexts(shared), "word int, slot int, n long")
        .repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
        .groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("found"))  # at most 2 * size entries
    )
    counted = materialise(counted, "lm-contexts")
    shared.unpersist()
    pairs = counted.where("word < 0").select((-1 - F.col("word")).alias("pair"), F.col("found")[0]["n"].alias("n")).toArrow()
    table = np.zeros(vocabulary.size**2)
    table[np.asarray(pairs["pair"].combine_chunks())] = np.asarray(pairs["n"].combine_chunks())
    return counted, table.reshape(vocabulary.size, -1)


def _class_pairs(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often a class precedes another."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    table = np.zeros(vocabulary.size**2)
    counted = small_batches(texts.select("text")).mapInArrow(_count_classes(shared), "pair long, n long")
    pairs = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table[np.asarray(pairs["pair"].combine_chunks())] = np.asarray(pairs["n"].combine_chunks())
    shared.unpersist()
    return table.reshape(vocabulary.size, -1)


def _count_classes(shared) -> Callable:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = vocabulary.size
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                hashes, lengths, first = word_hashes(data, offsets)
                key = _key(hashes, lengths)
                before, own = _sequences(vocabulary.class_of(key, *vocabulary.places(key)), first, size - 1)
                total += np.bincount(before * size + own, minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    return count


def exchange_in_batches(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Move the words outside the core to their best classes, ROUNDS times; the pairs of classes.

    What comes to the driver is a class for every word of the vocabulary, thus bounded by HEAVY.
    """
    spark = texts.sparkSession
    best = None
    for _ in range(ROUNDS if len(vocabulary.words) > vocabulary.units else 0):
        contexts, table = _in_contexts(texts, vocabulary)
        if best is not None and likelihood(table) < likelihood(best[1]):
            discard(contexts)
            break
        best = vocabulary.of.copy(), table
        shared = spark.sparkContext.broadcast((table, vocabulary.classes, vocabulary.of))
        with arrow_batches(spark, 512):
            moved = contexts.where("word >= 0").mapInArrow(_move(shared), "word int, class short").toArrow()
        shared.unpersist()
        discard(contexts)
        vocabulary.of[np.asarray(moved["word"].combine_chunks())] = np.asarray(moved["class"].combine_chunks())
    else:
        table = _class_pairs(texts, vocabulary)
        if best is None or likelihood(table) >= likelihood(best[1]):
            return table
    vocabulary.of, table = best
    return table


class Model:
    """Everything that scoring needs in a task; bounded by HEAVY."""

    def __init__(self, vocabulary, table, tail_tokens, tail_words, tokens, distinct, ends):
        self.vocabulary, self.tokens, self.distinct, self.ends = vocabulary, tokens, distinct, ends
        size = vocabulary.size
        share = (table.sum(0) + 1) / (table.sum() + size)
        self.transition = np.log10((table + BETA * share) / (table.sum(1, keepdims=True) + BETA))
        in_class = np.bincount(vocabulary.of, vocabulary.counts, size).astype(float)
        kinds = np.bincount(vocabulary.of, minlength=size).astype(float)
        in_class[size - 1 - N_LENGTHS : size - 1] += tail_tokens
        kinds[size - 1 - N_LENGTHS : size - 1] += tail_words
        self.class_size = in_class + ALPHA * (kinds + 1)
        self.all = tokens + ALPHA * (distinct + 1)

    def tail_sizes(self) -> list[float]:
        return [float(x) for x in self.class_size[-1 - N_LENGTHS : -1]]


def train(texts: DataFrame) -> tuple[Model, DataFrame, Column]:
    """The model of ``texts`` (column ``text``), all word counts, and which of them are in its vocabulary."""
    words = materialise(count_words(texts), "lm-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    in_vocabulary = frequent(words)
    known = words.where(in_vocabulary).toArrow()
    vocabulary = Vocabulary(
        np.asarray(known["word"].combine_chunks()).view(np.uint64), np.asarray(known["n"].combine_chunks())
    )
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary.units + N_LENGTHS + 1
    pairs = (
        small_batches(texts.select("text")).mapInArrow(_count_neighbours(shared), "pair long, n long")
        .groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    )
    shared.unpersist()
    counts = np.zeros(size * size)
    counts[np.asarray(pairs["pair"].combine_chunks())] = np.asarray(pairs["n"].combine_chunks())
    vocabulary.classify(exchange(counts.reshape(size, size), vocabulary.units))
    table = exchange_in_batches(texts, vocabulary)
    kind = F.col("word").bitwiseAND(F.lit(7)).alias("kind")
    sums = words.where(F.col("word") != END).where(~in_vocabulary).groupBy(kind)
    tail_tokens, tail_words = np.zeros(N_LENGTHS), np.zeros(N_LENGTHS)
    for row in sums.agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # one row per length class
        tail_tokens[row["kind"]], tail_words[row["kind"]] = row["n"], row["words"]
    ends = words.where(F.col("word") == END).select("n").first()
    model = Model(vocabulary, table, tail_tokens, tail_words, tokens, distinct, ends[0] if ends else 0)
    return model, words, in_vocabulary


_PARTS = """row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double,
    words array<long>, times array<int>"""


def _score(shared) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        boundary = model.vocabulary.size - 1
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("row", "doc_id", "held_out")]
                    + _parts(model, boundary, data, offsets, hi - lo),
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
                )

    return score


def _parts(model: Model, boundary: int, data: np.ndarray, offsets: np.ndarray, n: int) -> list[pa.Array]:
    hashes, lengths, first = word_hashes(data, offsets)
    keys = _key(hashes, lengths)
    known, place = model.vocabulary.places(keys)
    classes = model.vocabulary.class_of(keys, known, place)
    owner = np.repeat(np.arange(n), np.diff(first))
    before, own = _sequences(classes, first, boundary)
    score = np.bincount(np.repeat(np.arange(n), np.diff(first) + 1), model.transition[before, own], n)
    at, count = owner[known], model.vocabulary.counts[place[known]]
    base = np.bincount(at, np.log10((count + 0.5) / model.all), n)
    base += np.log10((model.ends + 0.5) / model.all)
    score += np.bincount(at, np.log10((count + ALPHA) / model.class_size[classes[known]]), n)
    n_known = np.bincount(at, minlength=n) + (model.ends > 0)
    rare, rare_owner = keys[~known], owner[~known]
    order = np.lexsort((rare, rare_owner))
    rare, rare_owner = rare[order], rare_owner[order]
    new = np.ones(len(rare), bool)
    new[1:] = (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(rare))).astype(np.int32)
    lists = np.searchsorted(rare_owner[starts], np.arange(n + 1)).astype(np.int32)
    return [
        pa.array(np.diff(first) + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score),
        pa.ListArray.from_arrays(lists, pa.array(rare[starts].view(np.int64))),
        pa.ListArray.from_arrays(lists, pa.array(times)),
    ]


def scored(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are the words (runs without white space, A-Z lower-cased) and one end. The model and
    the counts come from the rows that are not held out, repeated rows counting each time.
    ``base_score`` is the smoothed unigram log10 probability, ``score`` the class model's. A
    null text is empty: one token. Without training rows every word has count 0. An empty table
    gives an empty result. Extra columns are left behind.
    """
    texts = whole_texts(documents)
    model, words, in_vocabulary = train(texts.where(~held_out(F.col("doc_id"))))
    shared = texts.sparkSession.sparkContext.broadcast(model)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = materialise(small_batches(rows).mapInArrow(_score(shared), _PARTS), "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    light = words.where(~in_vocabulary)
    count = F.coalesce("n", F.lit(0))
    size = F.get(F.array(*[F.lit(x) for x in model.tail_sizes()]), F.col("word").bitwiseAND(F.lit(7)).cast("int"))
    rest = (
        rare.join(light, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rest_known"),
            F.sum(F.col("times") * F.log10((count + 0.5) / F.lit(float(model.all)))).alias("rest_base"),
            F.sum(F.col("times") * F.log10((count + ALPHA) / size)).alias("rest_score"),
        )
    )
    return parts.drop("words", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )

"""Adaptive context-mixing range coder for blocks of 16-bit token ids.

Every id has predictions of two orders: the id last seen after the two ids before it (order 2)
and after the one before it (order 1), each with a confidence from its hits and misses. The
pair of confidences chooses an adaptive distribution over "as order 2 says", "as order 1 says"
and the order-0 classes of ids by bit length; so the orders' probabilities are mixed by how
they did before. The remaining bits of an id that was not predicted are coded as they are.

A block starts with fresh statistics and is decoded by itself. Blocks are coded side by side,
one step of all of them at a time, with numpy.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
SLOTS = 1 << 12
SURE = 3
SYMBOLS = 2 + 17
STEP, LIMIT = 24, 1 << 12
_LENGTHS = np.zeros(1 << 16, np.int32)
for _bits in range(17):
    _LENGTHS[(1 << _bits) >> 1 : 1 << _bits] = _bits
_LITERAL = _LENGTHS + 2
_REST = np.maximum(_LENGTHS - 1, 0)  # bits after the leading one
_BASE = np.where(np.arange(17) > 0, 1 << np.maximum(np.arange(17) - 1, 0), 0).astype(np.int32)
_BOTTOM = np.uint64(1 << 32)
_TOP = np.uint64(1 << 48)
_16 = np.uint64(16)


class _Model:
    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.slot = self.lane * SLOTS
        self.seen = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]  # id * 4 + confidence
        self.counts = np.ones((lanes * (SURE + 1) ** 2, SYMBOLS), np.int32)
        self.counts[:, 2:] = 2
        self.before = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative counts and the predictions' slots for the next id."""
        second = (self.before * 40503 + self.before2 * 30011) >> 3
        self.at = [self.slot + (second & (SLOTS - 1)), self.slot + (self.before * 40503 >> 4 & (SLOTS - 1))]
        self.held = [s[a] for s, a in zip(self.seen, self.at)]
        self.row = self.lane * (SURE + 1) ** 2 + (self.held[0] & SURE) * (SURE + 1) + (self.held[1] & SURE)
        counts = self.counts[self.row]
        return counts, np.cumsum(counts, axis=1, dtype=np.int32)

    def symbol(self, ids: np.ndarray) -> np.ndarray:
        by2 = (self.held[0] >> 2 == ids) & (self.held[0] & SURE > 0)
        by1 = (self.held[1] >> 2 == ids) & (self.held[1] & SURE > 0)
        return np.where(by2, 0, np.where(by1, 1, _LITERAL[ids]))

    def learn(self, ids: np.ndarray, symbol: np.ndarray, total: np.ndarray) -> None:
        self.counts[self.row, symbol] += STEP
        full = self.row[total > LIMIT]
        if len(full):
            self.counts[full] = self.counts[full] + 1 >> 1
        for seen, at, held in zip(self.seen, self.at, self.held):
            sure = held & SURE
            hit = held >> 2 == ids
            kept = held + np.where(hit, sure < SURE, -1)
            seen[at] = np.where(hit | (sure > 1), kept, ids * 4 + 1)
        self.before2, self.before = self.before, ids


def _shift(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Lanes whose range has become short; where a carry could still come, it is cut first."""
    short = np.flatnonzero(wide < _BOTTOM)
    if len(short):
        l, w = low[short], wide[short]
        wide[short] = np.where((l ^ (l + w)) >= _TOP, (~l + np.uint64(1)) & (_BOTTOM - np.uint64(1)), w)
    return short


class _Writer:
    def __init__(self, lanes: int, length: int):
        self.low = np.zeros(lanes, np.uint64)
        self.wide = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.out = np.zeros((lanes, 2 * length + 16), np.uint16)
        self.used = np.zeros(lanes, np.int64)

    def put(self, start, size, total, rest, bits) -> None:
        """Code the part ``start .. start + size`` of ``total``, and ``rest`` in ``bits`` bits inside it."""
        unit = self.wide // total.astype(np.uint64)
        self.wide = unit * size.astype(np.uint64) >> bits.astype(np.uint64)
        self.low += unit * start.astype(np.uint64) + self.wide * rest.astype(np.uint64)
        while len(short := _shift(self.low, self.wide)):
            self.out[short, self.used[short]] = self.low[short] >> np.uint64(48)
            self.used[short] += 1
            self.low[short] <<= _16
            self.wide[short] <<= _16

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[np.arange(len(self.low)), self.used] = self.low >> np.uint64(48)
            self.used += 1
            self.low <<= _16
        return [row[:n].astype(">u2").tobytes() for row, n in zip(self.out, self.used)]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        longest = max(map(len, blocks)) // 2 + 8
        self.words = np.zeros((len(blocks), longest), np.uint64)
        for row, block in zip(self.words, blocks):
            row[: len(block) // 2] = np.frombuffer(block, ">u2")
        self.low = np.zeros(len(blocks), np.uint64)
        self.wide = np.full(len(blocks), (1 << 64) - 1, np.uint64)
        self.code = np.zeros(len(blocks), np.uint64)
        for i in range(4):
            self.code = self.code << _16 | self.words[:, i]
        self.used = np.full(len(blocks), 4)

    def value(self, total) -> np.ndarray:
        """Where the code lies in ``total`` parts."""
        self.unit = self.wide // total.astype(np.uint64)
        found = (self.code - self.low) // self.unit
        return np.minimum(found, total.astype(np.uint64) - np.uint64(1)).astype(np.int32)

    def rest(self, start, size, bits) -> np.ndarray:
        """The bits inside the part that was found; goes on to the next."""
        self.low += self.unit * start.astype(np.uint64)
        self.wide = self.unit * size.astype(np.uint64) >> bits.astype(np.uint64)
        rest = np.minimum((self.code - self.low) // self.wide, (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))
        self.low += self.wide * rest
        while len(short := _shift(self.low, self.wide)):
            at = np.minimum(self.used[short], self.words.shape[1] - 1)  # only a damaged block goes on
            self.code[short] = self.code[short] << _16 | self.words[short, at]
            self.used[short] += 1
            self.low[short] <<= _16
            self.wide[short] <<= _16
        return rest.astype(np.int32)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[int]]:
    """The blocks of an array of ids below 65,536, and the CRC-32 of each block's ids."""
    full = len(ids) // block
    coded: list[bytes] = []
    for part in (ids[: full * block].reshape(full, block), ids[full * block :].reshape(1, -1)):
        if not part.size:
            continue
        model, writer = _Model(len(part)), _Writer(len(part), part.shape[1])
        steps = np.ascontiguousarray(part.T).astype(np.int32)
        for now in steps:
            counts, sums = model.predict()
            symbol = model.symbol(now)
            size = counts[model.lane, symbol]
            total = sums[:, -1]
            bits = np.where(symbol > 1, _REST[now], 0)
            rest = now & (np.left_shift(1, bits) - 1)
            writer.put(sums[model.lane, symbol] - size, size, total, rest, bits)
            model.learn(now, symbol, total)
        coded += writer.finish()
    raw = ids.astype("<u2")
    return coded, [zlib.crc32(raw[i : i + block].tobytes()) for i in range(0, len(raw), block)]


def decode(blocks: list[bytes], checks: list[int], length: int, block: int = BLOCK) -> np.ndarray:
    """The ids of ``encode``; raises ValueError where a block does not fit its checksum."""
    out = np.zeros(length, np.uint16)
    full = length // block
    for some, at, own in ((blocks[:full], 0, block), (blocks[full:], full * block, length - full * block)):
        if not some or not own:
            continue
        model, reader = _Model(len(some)), _Reader(some)
        steps = np.zeros((own, len(some)), np.uint16)
        for i in range(own):
            counts, sums = model.predict()
            total = sums[:, -1]
            value = reader.value(total)
            symbol = (sums <= value[:, None]).sum(1)
            size = counts[model.lane, symbol]
            kind = np.maximum(symbol - 2, 0)
            bits = np.where(symbol > 1, np.maximum(kind - 1, 0), 0)
            rest = reader.rest(sums[model.lane, symbol] - size, size, bits)
            now = np.where(symbol == 0, model.held[0] >> 2, np.where(symbol == 1, model.held[1] >> 2, _BASE[kind] + rest))
            model.learn(now, symbol, total)
            steps[i] = now
        out[at : at + own * len(some)] = np.ascontiguousarray(steps.T).reshape(-1)
    raw = out.astype("<u2")
    for i, check in enumerate(checks):
        if zlib.crc32(raw[i * block : (i + 1) * block].tobytes()) != check:
            raise ValueError(f"block {i} is damaged")
    return out

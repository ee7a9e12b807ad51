"""Token ids of whole texts with a public tokenizer, remembering words.

A text is cut before every space that follows a character other than white space, and a piece
again into a word, the punctuation behind it, and lines. The tokenizers used here never join
characters across such places, so the ids of a text are the ids of its parts in a row. Every
word is encoded once while a Python worker remembers it; all new words of a batch go to the
tokenizer in few calls. Any piece of another form is encoded as it is.

Texts of nothing but letters, digits, single spaces, line breaks, full stops and commas are cut into
words and signs at once. New words of basic Latin letters need neither the tokenizer's
normaliser nor its search for words, so its model gets them split at spaces.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from askgrade.llm.common import HELD, give_back

REMEMBERED = 200_000  # in each of two generations; about 40 MB
AT_ONCE = 20_000
IN_A_LINE = 2_000  # words that the bare model gets in one string
_CUT = re.compile(r"(?<=\S)(?= )")
_BEFORE_SPACE = re.compile(r"\s ")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")  # letters that composition leaves alone
#: The character by which byte-level vocabularies write each byte from 0xA1 up is its own, except 0xAD.
_BYTE_CHARS = {i: 256 + n for n, i in enumerate([*range(33), *range(127, 161), 173])}
_SPLIT_LOWER = "İ"  # its lower case holds a mark, which goes with the signs behind it
_BREAK = "\0"  # stands for a line break among the pieces of a plain text


class Memo:
    """Two generations of a dictionary: what was used since the older one filled up is kept."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that are not known; the others are in ``new`` afterwards."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        out = list(keys.difference(new))
        if not old:
            return out
        known = [key for key in out if key in old]
        new.update((key, old[key]) for key in known)
        return [key for key in out if key not in old] if known else out

    def rest(self) -> None:
        """Between tasks only the newer generation is kept."""
        self.old = {}


class Encoder:
    """Encodes texts as arrays of 16-bit ids (all ids of the vocabularies used are below 65,536)."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        vocabulary = self.tokenizer.get_vocab()
        # of byte-level ids the first of a word shows the space before it, of the others the last its end
        self.byte_level = len(self._ids("a\na")) == 3
        self.edges = np.zeros(1 << 16, bool)
        marked = [i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.byte_level else t.endswith("</w>"))]
        self.edges[marked] = True
        self.line = self._encode_one("\n")
        self.no_case = self._ids("A") == self._ids("a")
        self.pieces, self.words, self.signs = Memo(), Memo(), {"": b""}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_one(self, text: str) -> bytes:
        return np.array(self._ids(text), np.uint16).tobytes()

    def _ids_of_latin(self, words: list[str]) -> list[int]:
        """Ids of words of basic Latin letters with a space before, from the model alone."""
        ids: list[int] = []
        for at in range(0, len(words), IN_A_LINE):
            line = " ".join(words[at : at + IN_A_LINE])
            if self.byte_level:
                line = "Ġ" + line.replace(" ", " Ġ")
            else:
                line = line.lower() if self.no_case else line
            if not line.isascii():
                line = line.replace("Ġ", "\n").encode().decode("latin-1").translate(_BYTE_CHARS)
                line = line.replace("Ġ", " ").replace("Ċ", "Ġ")
            ids += self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids
        return ids

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters with a space before, or, if they begin with a line break, behind it; any
        other as it is."""
        known = self.words.new
        ascii_, latin, spaced, behind = [], [], [], []
        for w in words:
            if not w.isalpha():
                if w[0] != "\n":  # of a plain text: words with digits, signs, and words right behind one
                    known[w] = self.line if w == _BREAK else self._encode_one(w if w[0] in ".," else " " + w)
                elif w[1:].isalpha():
                    behind.append(w)
                else:
                    known[w] = self._encode_one(w[1:])
            elif w.isascii():
                ascii_.append(w)
            elif _LATIN.fullmatch(w):
                latin.append(w)
            else:
                spaced.append(w)
        latin = ascii_ + latin
        for group, join, bare in ((latin, " ", True), (spaced, " ", False), (behind, "", False)):
            for at in range(0, len(group), AT_ONCE):
                some = group[at : at + AT_ONCE]
                ids = self._ids_of_latin(some) if bare else self._ids(join + join.join(some))
                ids = np.array(ids, np.uint16)
                if join:
                    found = np.flatnonzero(self.edges[ids])
                    starts = found if self.byte_level else np.concatenate([[0], found[:-1] + 1])
                    ends = np.append(found[1:], len(ids)) if self.byte_level else found + 1
                else:
                    starts = np.flatnonzero(ids == np.frombuffer(self.line, np.uint16)[0]) + 1
                    ends = np.append(starts[1:] - 1, len(ids))
                if len(starts) != len(some):  # not expected; then one by one
                    known.update((w, self._encode_one(w[1:] if w[0] == "\n" else " " + w)) for w in some)
                    continue
                raw = ids.tobytes()
                known.update(
                    (w, raw[a:b]) for w, a, b in zip(some, (starts * 2).tolist(), (ends * 2).tolist())
                )

    def _parts(self, piece: str) -> list[tuple[str, str]] | None:
        """(word, signs behind it) of every line of a piece, or None for a piece of another form."""
        out = []
        for i, line in enumerate(piece.split("\n")):
            word = line.rstrip(string.punctuation)
            if not word.isalpha():
                return None
            sign = line[len(word) :]
            if self.no_case:
                word = word.lower() if word.isascii() else word
            elif i:
                word = "\n" + word
            out.append((word, sign))
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that follow a space and hold none."""
        simple: list[tuple[str, str, int]] = []
        lines: list[tuple[str, list[tuple[str, str]]]] = []
        known, signs, lower, marks = self.pieces.new, self.signs, self.no_case, string.punctuation
        for piece in pieces:
            word = piece.rstrip(marks)
            if lower and _SPLIT_LOWER in piece:
                known[piece] = self._encode_one(" " + piece)
            elif word.isalpha():
                simple.append((piece, word.lower() if lower and word.isascii() else word, len(word)))
            elif (parts := self._parts(piece)) is not None:
                lines.append((piece, parts))
            else:
                known[piece] = self._encode_one(" " + piece)
        wanted = {x[1] for x in simple}
        wanted.update(word for _, parts in lines for word, _ in parts)
        new = self.words.missing(wanted)
        if new:
            self._learn_words(new)
        words = self.words.new

        def signed(word: str, sign: str) -> bytes:
            if sign not in signs:
                if len(signs) > 1 << 14:
                    signs.clear()
                signs[sign] = self._encode_one(sign) if sign else b""
            return words[word] + signs[sign]

        for piece, word, n in simple:
            known[piece] = words[word] if n == len(piece) else signed(word, piece[n:])
        line = self.line if self.byte_level else b""
        for piece, parts in lines:
            known[piece] = line.join([signed(word, sign) for word, sign in parts])

    def _plain(self, text: str) -> list[str] | None:
        """Words, numbers, full stops, commas and line breaks of a text of no others, or None for any other text. Words after
        a line break and the first one begin with a line break if a space before a word counts."""
        if not self.byte_level and (not self.no_case or _SPLIT_LOWER in text):
            return None
        if not text.replace(" ", "").replace(".", "").replace(",", "").replace("\n", "").isalnum():
            return None
        if self.byte_level:
            cut = "\n" + text.replace("\n", f" {_BREAK} \n")
            cut = cut.replace(".", " .").replace(",", " ,")
            if "  " in cut or "\n " in cut or cut[-1] in " \n":
                return None
        else:
            cut = (text.lower() if text.isascii() else text).replace(".", " .").replace(",", " ,")
        if ". ." in cut or ". ," in cut or ", ." in cut or ", ," in cut:
            return None
        return cut.split(" ") if self.byte_level else cut.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes] = [b""] * len(texts)
        plain = [(i, p) for i, p in enumerate(map(self._plain, texts)) if p is not None]
        others = set(range(len(texts))).difference(i for i, _ in plain)
        new = self.words.missing(set().union(*[p for _, p in plain]))
        if new:
            self._learn_words(new)
        find = self.words.new.__getitem__
        for i, pieces in plain:
            out[i] = b"".join(map(find, pieces))
        for i, ids in zip(sorted(others), self._encode_others([texts[i] for i in sorted(others)])):
            out[i] = ids
        return [np.frombuffer(x, np.uint16) for x in out]

    def _encode_others(self, texts: list[str]) -> list[bytes]:
        cut: list[tuple[str, list[str]]] = []
        wanted: set[str] = set()
        for text in texts:
            if "  " in text or "\n " in text or "\t " in text or "\r " in text or _odd(text):
                first, *pieces = _CUT.split(text)
                rest = [p[1:] for p in pieces]
                if any(" " in p or p != p.strip() for p in rest):
                    first, rest = text, []  # spaces in a row: as one piece
            else:
                first, *rest = text.split(" ")
            if not self.byte_level:  # without marks for spaces the first piece is like the others
                first, rest = "", [first, *rest]
            cut.append((first, rest))
            wanted.update(rest)
        new = self.pieces.missing(wanted)
        if new:
            self._learn(new)
        find = self.pieces.new.__getitem__
        return [(self._encode_one(first) if first else b"") + b"".join(map(find, rest)) for first, rest in cut]

    def rest(self) -> None:
        """Give memory back between tasks, since another step may run in this worker next."""
        self.pieces.rest()
        self.words.rest()
        give_back()


def _odd(text: str) -> bool:
    """White space other than ASCII's common kinds before a space."""
    return ("\x0b" in text or "\x0c" in text or not text.isascii()) and _BEFORE_SPACE.search(text) is not None


def encoder(file: str) -> Encoder:
    """One for each Python worker and vocabulary file."""
    if file not in HELD:
        HELD[file] = Encoder(file)
    return HELD[file]

"""Texts that the encoder cuts into words and signs at once, and words that its model gets without the normaliser."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from askgrade.llm.tokens import Encoder, Memo

PARTS = ["a", "Be", "é", "ß", "İ", "Ÿ", "ª", "中", "я", "7", "12", "½", "tion", " and", " Été", ".", ",", "\n", " "]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_texts(file):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["one two, three.\nFour 5 six.", "x İ. y", "İ,", "x.5 y", "a.\n", ".", "\n", "x. y ."]
    coder = Encoder(file)
    got = [x.tolist() for x in coder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_plain_texts_are_learned_once():
    """Such a text leaves no pieces of word and sign behind, only words."""
    coder = Encoder("word_bpe_49k.json")
    coder.encode(["Ab cd, ab.\nAb CD 12."])
    assert not coder.pieces.new and set(coder.words.new) == {"ab", "cd", "12", ",", "."}


def test_memo_brings_older_keys_over():
    memo = Memo(1)
    memo.new.update(a=1, b=2)
    assert memo.missing({"a", "c"}) == ["c"] and memo.new == {"a": 1} and memo.old == {"a": 1, "b": 2}

"""Folding found tags over a text gives what one replacement after the other gives, and does not grow with both."""

import random
import time
from functools import reduce

from askgrade.functions import markers

MARKER = " has_external_tag "


def plainly(text, words):
    return reduce(lambda acc, w: acc.replace(w, MARKER), words, text)


def test_fold_is_one_replacement_after_the_other(monkeypatch):
    rng = random.Random(3)
    for _ in range(3000):
        letters = rng.choice(["ab", "ab_ ", "abc.+ ", "hase_ x", "x\0 ", "aé́. "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        words += rng.choice([[], ["has", "external", "tag", "_"]])
        if rng.random() < 0.7:
            words = sorted(set(words), key=lambda w: (-len(w), w))
        monkeypatch.setattr(markers, "FEW", 0)
        monkeypatch.setattr(markers, "MANY", rng.choice([0, 1000]))
        assert markers._fold(text, words, MARKER) == plainly(text, words), (text, words)


def test_words_with_one_beginning_are_not_compared_at_every_place():
    """Every word was compared wherever its first four letters stand: 36 million times here."""
    words = [f"abcd{i:05d}" for i in range(6000)]
    text = ", ".join(words) + " abcdx"
    begun = time.perf_counter()
    done = markers._fold(text, words, MARKER)
    assert time.perf_counter() - begun < 2
    assert done == ", ".join([MARKER] * 6000) + " abcdx"

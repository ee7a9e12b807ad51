"""Tables and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = "the of and to in is it for on with".split()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def prose(rng: random.Random, n: int) -> str:
    """Invented text of ``n`` words in lines."""
    out = []
    for i in range(n):
        word = rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
        out.append(word + ("\n" if i % 25 == 24 else " "))
    return "".join(out).strip()


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with nulls, empty and very long texts, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((1, 2, 3, 8, 12, 60, 150))) for _ in range(n)]
    base = prose(rng, 200)
    texts += [base, base + " ", base.upper(), base.replace(" ", "  ", 3)]
    for _ in range(6):
        own = base.split(" ")
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [None, "", " \n\t ", "ÄÖ ß 東京 \U0001f600", "a" * 30_000, prose(rng, 6_000), "x", "x"]
    out = [(i * 3 + 1, t, rng.choice(("en", "de", None)), rng.choice(("hot", "hot", "rare", None)), len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, prose(rng, 40), None, None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


def table(spark, data=None, clashing: bool = False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if clashing:
        for name in ("n", "k", "h", "row", "rank", "word", "words", "score", "component", "node", "s", "sig", "length",
                     "piece", "norm", "salt", "topic", "weight", "probability", "leaf", "pos", "line", "count", "label",
                     "predicted", "_stats", "_score", "_k", "_h"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def same(a, b) -> bool:
    """Rows as multisets, floats rounded."""
    def plain(df):
        names = sorted(df.columns)
        return sorted(
            str(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names)) for r in df.collect()
        )

    return plain(a) == plain(b)

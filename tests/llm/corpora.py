"""Small documents with every awkward case, and plain readings of the contracts to hold results against."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, fp string, label string, word long"


def documents(seed: int = 7) -> list[tuple]:
    """(doc_id, text): prose, copies, near copies, shared lines and passages, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(seed)
    vocab = [a + b for a in "ba ko ri su té mo".split() for b in "la ne ti vu x".split()]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = "This Line is boilerplate " + sentence(9)
    passage = sentence(60)
    texts: list[str | None] = [None, "", "   ", "\n", "one", "One", "two words", "ÀÉ ÀÉ", "àé àé", "a\nb\n\n", "x" * 5000]
    for i in range(24):
        body = "\n".join(sentence(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 4)))
        if i % 3 == 0:
            body += f"\n {shared.upper() if i % 2 else shared}\t"
        if i % 5 == 0:
            body = f"{body} {passage} {sentence(8)}"
        texts.append(body)
    texts += [texts[12], texts[12].upper(), texts[13] + " more", texts[14], "word " * 20000]
    rows = list(enumerate(texts, start=100))
    rng.shuffle(rows)
    return [*rows, rows[3], (None, "a row without an id"), (500, None)]


def frame(spark, rows):
    """The rows with nulls in the other columns, and columns that clash with names the operators use."""
    full = [(i, t, *((None, None, None) if k % 4 == 0 else ("en" if k % 2 else "fr", "s", 1)), k, "f", "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")

"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """texts: (doc_id, text) pairs; ``extra`` adds columns whose names the operators use inside."""
    if not extra:
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).repartition(3)
    names = "row struct<a:int>, _id long, _bytes string, node long, digest string, key long, bytes binary, score double, label int"
    return spark.createDataFrame([(i, t, "en", "s", 0, (1,), 5, "b", 1, "d", 2, b"x", 0.5, 3) for i, t in texts], f"{SCHEMA}, {names}")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for _ in range(words):
        out.append("".join(r.choice(["ba", "lo", "ti", "ren", "sù", "ka", "mo"]) for _ in range(r.randint(1, 4))))
        if r.random() < 0.1:
            out[-1] += "."
    return " ".join(out)


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empties, short and repetitive texts."""
    base = [prose(k, 120) for k in range(12)]
    out: list[tuple[int | None, str | None]] = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k % 3]) for k in range(9)]
    out += [(200 + k, edited(base[4], k, 3)) for k in range(12)]
    out += [(300 + k, edited(base[5], 50 + k, 14)) for k in range(6)]
    out += [(400 + k, prose(900 + k, 40) + " " + base[7][:260] + " " + prose(950 + k, 40)) for k in range(5)]
    out += [(500, None), (501, ""), (502, "  \n\t "), (503, "Uno"), (504, "uno"), (505, "a b c"), (506, "la " * 3000), (507, "xyz" * 400), (508, base[2][:-1])]
    return out

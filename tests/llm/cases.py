"""Documents with the hard cases that every operator must handle, and plain versions of what they define."""

from __future__ import annotations

import random
from hashlib import sha256

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


def sha(data: bytes | str) -> str:
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["the", "stone", "River", "über", "naïve", "日本語", "😀", "of", "a", "light", "Garden", "seven", "x" * 30, "quiet", "it's"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, passage = prose(12), prose(80)
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n\r\x0b\x0c "), (3, "word"), (4, "\n\n\n")]
    out += [(i, f"{prose(30)}\n{shared}\n{prose(10)}") for i in range(10, 24)]
    out += [(i, f"{prose(20)}\n{passage}") for i in range(30, 36)]
    out += [(40, out[6][1]), (41, out[6][1]), (42, prose(6000)), (43, "of " * 400), (44, passage), (45, "\x1c a\x85b c d ")]
    out += [(10, out[5][1]), (None, "no id " + prose(20)), (None, None), (46, "A\r\nB\rC\n"), (47, prose(15).upper()), (48, "ſecret K token")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "mine", "mine") for i, t in rows], SCHEMA)

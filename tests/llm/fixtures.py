"""Small tables with the cases every operator must bear."""

from __future__ import annotations

import hashlib
import random

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# A few words of each language.
WORDS = {
    "en": "the and of to in is that was for with this from they have which their would there about could".split(),
    "de": "der die und das nicht mit auch sich auf eine werden über können müssen schön größer zwischen durch während".split(),
    "fr": "le la les des une dans pour avec être cette plus très même après où déjà français leurs nous voilà".split(),
    "es": "el los las una para con más está también según año niño aquí después mañana porque cuando señor donde muy".split(),
}


def text(rng: random.Random, lang: str, words: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


def documents(count: int = 120, seed: int = 1) -> list[tuple]:
    """Documents in four languages with exact and near copies, shared passages and the odd cases."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = ["en", "de", "fr", "es"][i % 4]
        rows.append([i, text(rng, lang, rng.randint(20, 120)), lang, f"src{i % 3}", 0])
    passage = text(rng, "en", 60)
    for i in range(5, count, 11):
        rows[i][1] = rows[i][1] + " " + passage + " " + rows[i][1][:40]
    for i in range(10, count, 13):
        rows[i][1] = rows[i - 8][1]
    for i in range(12, count, 17):
        rows[i][1] = rows[i - 4][1] + " the"
    rows += [
        [count, None, "en", "src0", None],
        [count + 1, "", "en", None, 0],
        [count + 2, "12345 !!! 678", "de", "src1", 0],
        [count + 3, "ab " * 3000, None, "src1", 0],
        [count + 4, text(rng, "fr", 30000), "fr", "src2", 0],
        [count + 5, "x" * 5000, "en", "", 0],
        [None, text(rng, "es", 50), "es", "src2", 0],
        rows[3][:],
        [7, text(rng, "de", 40), "de", "src9", 0],
    ]
    return [tuple(r[:4]) + (len(r[1]) if r[1] is not None else None,) for r in rows]


def brute_repeats(rows: list[tuple[int, bytes]], window: int = 100) -> list[tuple[int, int, int, int, str]]:
    """doc_id, bytes, removed bytes, runs, digest of the rest: every byte of a window that starts earlier goes; rows in order of doc_id."""
    seen: set[bytes] = set()
    out = []
    for doc, data in rows:
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                gone[i : i + window] = True
            seen.add(part)
        gone = gone[: len(data)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone]) if len(data) else b""
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out

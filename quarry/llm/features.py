"""A fixed set of numbers that describe the make-up of a whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm.tokens import word_codes

_CLASS = np.zeros(256, np.int64)  # 0: other ASCII
for _c in range(256):
    if _c >= 128:
        _CLASS[_c] = 1
    elif chr(_c).isupper():
        _CLASS[_c] = 2
    elif chr(_c).islower():
        _CLASS[_c] = 3
    elif chr(_c).isdigit():
        _CLASS[_c] = 4
    elif chr(_c) in " \t\n\x0b\x0c\r":
        _CLASS[_c] = 5
    elif chr(_c) in "#*$%&<>":
        _CLASS[_c] = 6
    elif chr(_c) == "|":
        _CLASS[_c] = 7
    elif chr(_c) == "!":
        _CLASS[_c] = 8
    elif chr(_c) in ".,;:?":
        _CLASS[_c] = 9

NAMES = ("upper", "digit", "symbol", "bar", "shout", "stop", "other", "same_next", "same_far", "top_word", "variety", "word_length", "log_words", "dup_lines", "few_words")


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text, all between 0 and 1; a null text counts as empty."""
    offsets, codes, _ = word_codes(texts)
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts.to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)
        ink = max(1, len(raw) - n[5])
        letters = max(1, n[1] + n[2] + n[3])
        own = codes[offsets[i] : offsets[i + 1]]
        words = max(1, len(own))
        _, held = np.unique(own, return_counts=True) if len(own) else (None, np.zeros(1))
        lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
        out[i] = (
            n[2] / letters,
            n[4] / ink,
            n[6] / ink,
            n[7] / ink,
            n[8] / ink,
            n[9] / ink,
            n[0] / ink,
            np.count_nonzero(own[1:] == own[:-1]) / words,
            np.count_nonzero(own[2:] == own[:-2]) / words,
            held.max() / words,
            len(held) / words,
            min(1.0, ink / words / 20),
            min(1.0, np.log1p(len(own)) / 12),
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            max(0.0, 1 - len(own) / 20),
        )
    return out

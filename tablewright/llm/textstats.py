"""Counts over whole texts that the quality rules rest on."""

from __future__ import annotations

import numpy as np
import pandas as pd

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_PLACES = np.random.Generator(np.random.PCG64(55)).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of five words that occurs twice or more; the first time counts too."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled += hashes[i : i + n] * _PLACES[i]
    rolled ^= rolled >> np.uint64(29)
    _, where, counts = np.unique(rolled, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words); zeros for null.

    Lines count if they hold a word; a repeated one equals an earlier line.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )

"""The pieces that a byte-level BPE merges within, found with numpy instead of one regex match at a time.

The rule is the one of the public byte-level vocabularies: contractions; runs of letters, numbers or other signs, each
with at most one blank before it; white space, of which a run leaves its last character to what follows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

#: The contractions that are pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: The letters and numbers that Unicode 16 added, which older tables lack.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE] = SPACE
    return table


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order; joined, they are the text."""
    n = len(text)
    if not n:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    space = kind == SPACE
    start = first.copy()
    start[1:] &= points[:-1] != 32  # the blank before takes the run along; undone for white space below
    start |= space & first
    start[:-1] |= space[:-1] & ~space[1:]  # the last of a run of white space goes by itself or with what follows
    quotes = np.flatnonzero((points == 39) & start)
    quotes = quotes[quotes < n - 1]
    for at in quotes[kind[quotes + 1] == LETTER].tolist():
        for c in CONTRACTIONS:
            if text.startswith(c, at):
                start[at + 1] = False
                end = at + len(c)
                if end < n and kind[end] == LETTER:
                    start[end] = True
                break
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [n], strict=True)]

"""Splitting flat UTF-8 texts into the pieces that byte-level BPE merges, for whole batches at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
# The code points of Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
               0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings that split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
APOSTROPHE, BLANK = ord("'"), ord(" ")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def split(data: np.ndarray, offsets: np.ndarray, keep_blank: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where pieces begin (with the end), the class of each piece, and the first piece of each text.

    Letters, numbers, white space and the rest form runs; an ending such as 's splits off. With ``keep_blank``
    one blank before a run belongs to it and white space is a piece; without, each number stands alone and
    white-space pieces are there for the caller to leave out.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    first_point = np.searchsorted(at_byte, offsets)
    kind = classes()[points]
    n = len(points)
    text_begins = np.zeros(n + 1, bool)
    text_begins[first_point] = True
    begins = np.zeros(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins |= text_begins
    if keep_blank:
        after = np.flatnonzero(begins[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~text_begins[1:n]) + 1
        begins[after - 1] = True  # the last blank of a run stands apart from the others
        begins[after[points[after - 1] == BLANK]] = False
    else:
        begins[:n] |= kind == NUMBER
    _split_endings(points, kind, begins, text_begins)
    starts = np.flatnonzero(begins[:n])
    return np.append(at_byte[starts], len(data)), kind[starts], np.searchsorted(starts, first_point)


def _split_endings(points, kind, begins, text_begins) -> None:
    n = len(points)
    marks = np.flatnonzero((points[:-1] == APOSTROPHE) & begins[:n - 1] & ~text_begins[1:n])
    for ending in ENDINGS:
        found = marks[marks + len(ending) < n]
        for i, letter in enumerate(ending, 1):
            found = found[(points[found + i] == ord(letter)) & ~text_begins[found + i]]
        begins[found + 1] = False
        nxt = found + 1 + len(ending)
        begins[nxt[(nxt < n) & (kind[np.minimum(nxt, n - 1)] == LETTER)]] = True

"""Texts as arrays of small character classes, many texts at once."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Of the 32 classes: start of text, a to z, white space, digits, sentence marks, other signs, other letters.
PAD, SPACE, DIGIT, MARK, SIGN, LETTER = 0, 27, 28, 29, 30, 31
MARKS = ".,;:!?'\"()-"


@cache
def folded() -> np.ndarray:
    """The class of every code point of the basic plane: letters lose case and accents."""
    table = np.full(65536, SIGN, dtype=np.uint8)
    for cp in range(1, 65536):
        c = chr(cp)
        if c.isspace():
            table[cp] = SPACE
        elif c.isdecimal():
            table[cp] = DIGIT
        elif c in MARKS:
            table[cp] = MARK
        elif c.isalpha():
            plain = unicodedata.normalize("NFD", c.lower())[0]
            table[cp] = ord(plain) - 96 if "a" <= plain <= "z" else LETTER
    table[0], table[65535] = PAD, LETTER
    return table


@cache
def lowered() -> np.ndarray:
    """The lower-case code point of every letter of the basic plane; 32 for what is no letter."""
    table = np.full(65536, 32, dtype=np.uint16)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    table[0] = 0
    return table


def points(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, those beyond the basic plane as 65535, with ``pad`` zeros before each text; where each begins."""
    lead = "\0" * pad
    joined = "".join([lead + t for t in texts])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) + pad for t in texts])
    return np.minimum(cps, 65535), np.concatenate([[0], ends[:-1]])

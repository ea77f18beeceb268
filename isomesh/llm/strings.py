"""The gap-weighted subsequence kernel on words, against a fixed set of landmark words.

Two words are alike as far as they share subsequences of three letters. A subsequence counts DECAY to the power of
the letters it spans, so "idxiot" and "i-d-i-o-t" stay close to "idiot"; spans over SPAN letters are left out. The
kernel is the product of these weights, summed over subsequences and divided by both words' norms.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

SPAN, DECAY = 7, 0.9
#: Offsets of the second and third letter, and the weight of such a subsequence.
OFFSETS = [(a, b, DECAY ** (b + 1)) for a, b in combinations(range(1, SPAN), 2)]
#: Longer words are read in overlapping parts of this length.
LONGEST = 24
#: Letters a to z, and 37 classes of other letters; 0 stands between words.
ALPHABET, OTHERS = 64, 37
CODES = ALPHABET**3
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$")
#: Digits and signs often written for letters.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def letters(token: str) -> str:
    """A token's letters in lower case, after look-alikes are put right; others than a to z become one of the
    characters after z."""
    token = token.lower().strip(EDGES)
    if not (token.isascii() and token.isalpha()):
        token = "".join(c if "a" <= c <= "z" else chr(123 + ord(c) % OTHERS) for c in token.translate(LOOKS) if c.isalpha())
    return token


def parts(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words as 1 to 63, with zeros between words; the word of each place."""
    gap = "`" * (SPAN - 1)
    flat = np.frombuffer((gap.join(words) + gap).encode("latin-1"), dtype=np.uint8).astype(np.int64) - 96
    sizes = np.array([len(w) for w in words], dtype=np.int64) + len(gap)
    return flat, np.repeat(np.arange(len(words)), sizes)


def subsequences(words: list[str]):
    """For each pair of offsets: places' words, codes of the subsequences there, and their weight."""
    c, word = laid_out(words)
    n = len(c) - SPAN + 1
    if n <= 0:
        return
    for a, b, weight in OFFSETS:
        code = np.where((c[:n] > 0) & (c[a : a + n] > 0) & (c[b : b + n] > 0), (c[:n] * ALPHABET + c[a : a + n]) * ALPHABET + c[b : b + n], 0)
        yield word[:n], code, weight


def profile(word: str) -> np.ndarray:
    """A word's weights by code."""
    out = np.zeros(CODES)
    for _, code, weight in subsequences([word]):
        np.add.at(out, code[code > 0], weight)
    return out


class Landmarks:
    """Kernel values of many words against the landmark words, of which the first ``strong`` are what is sought."""

    def __init__(self, words: list[str], strong: int, floor: float):
        self.words, self.strong, self.floor = words, strong, floor
        profiles = np.stack([profile(w) for w in words])
        profiles /= np.sqrt((profiles**2).sum(axis=1, keepdims=True))
        self.most = profiles[:strong].max(axis=0)
        # Only codes that some landmark has are kept; the first row is for all others.
        has = np.flatnonzero(profiles.max(axis=0))
        self.row = np.zeros(CODES, dtype=np.int32)
        self.row[has] = np.arange(1, len(has) + 1)
        self.table = np.vstack([np.zeros((1, len(words))), profiles[:, has].T]).astype(np.float32)

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words come near a strong landmark, and their kernel values; values under the floor are 0.

        A cheap bound finds the words that cannot come near: no strong landmark weighs a code more than ``most``,
        and no word's norm is smaller than if its subsequences were all different.
        """
        n = len(words)
        bound, norm = np.zeros(n), np.zeros(n)
        for word, code, weight in subsequences(words):
            bound += weight * np.bincount(word, self.most[code], minlength=n)
            norm += weight**2 * np.bincount(word, code > 0, minlength=n)
        near = np.flatnonzero(bound >= self.floor * np.sqrt(np.maximum(norm, 1e-12)))
        if not len(near):
            return near, np.zeros((0, len(self.words)), dtype=np.float32)
        codes, owners, weights = [], [], []
        for word, code, weight in subsequences([words[i] for i in near]):
            has = np.flatnonzero(code)
            codes.append(code[has])
            owners.append(word[has])
            weights.append(np.full(len(has), weight))
        code, owner, weight = map(np.concatenate, (codes, owners, weights))
        # Equal subsequences of a word add up before they are squared.
        keys, inverse = np.unique(owner * CODES + code, return_inverse=True)
        sums = np.bincount(inverse, weight)
        squares = np.bincount(keys // CODES, sums**2, minlength=len(near))
        row, of = self.row[keys % CODES], keys // CODES
        total = np.zeros((len(near), len(self.words)), dtype=np.float32)
        known = np.flatnonzero(row)
        # One sum at a time for every word: the k-th of its known subsequences.
        of, row, sums = of[known], row[known], sums[known].astype(np.float32)
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        for k in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == k)
            total[of[now]] += sums[now, None] * self.table[row[now]]
        value = total / np.sqrt(np.maximum(squares, 1e-12))[:, None].astype(np.float32)
        value[value < self.floor] = 0
        some = value[:, : self.strong].any(axis=1)
        return near[some], value[some]


def kernel(a: str, b: str) -> float:
    """Of two words, worked out plainly."""
    x, y = profile(a), profile(b)
    norms = np.sqrt((x**2).sum() * (y**2).sum())
    return float((x * y).sum() / norms) if norms else 0.0

"""BagMinHash: signatures of weighted sets whose equal components estimate weighted Jaccard similarity without bias.

The weights are counts. Every element has a Poisson process over (time, level): the part below its weight is what
a set sees of it, so two sets see the same points up to the smaller weight. Levels are split into [0, 1), [1, 2),
[2, 4), ...: intervals below the weight are seen whole, of the last one points above the weight are passed over.
Points come in order of time; each belongs to one component of the signature, which keeps its earliest point.
A process stops once its time is past the latest component of its set, so few points are drawn for each element.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stride(n: int) -> np.uint64:
    return np.uint64(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """Signatures (sets x size, uint32) of the sets that own the elements (uint64, distinct within a set)."""
    parts = [(elements, np.ones(len(elements)), np.zeros(len(elements)), weights, owner)]
    low = 1
    while len(more := np.flatnonzero(weights > low)):
        seed = mixed(elements[more] + stride(low))
        parts.append((seed, np.full(len(more), float(low)), np.full(len(more), float(low)), weights[more], owner[more]))
        low *= 2
    seed, width, floor, weight, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.full(sets * size, np.inf)
    points = np.zeros(sets * size, dtype=np.uint32)
    has = np.zeros(sets, dtype=bool)
    has[owner] = True
    time = np.zeros(len(seed))
    turn = 0
    while len(seed):
        turn += 1
        draw = mixed(seed + stride(turn))
        time = time - np.log(uniform(draw)) / width
        place = mixed(draw)
        at = of * size + (place % np.uint64(size)).astype(np.int64)
        seen = (floor + uniform(place) * width < weight) & (time < first[at])
        at, when, point = at[seen], time[seen], draw[seen]
        np.minimum.at(first, at, when)
        won = first[at] == when
        points[at[won]] = (point[won] >> np.uint64(32)).astype(np.uint32)
        latest = first.reshape(sets, size).max(axis=1)
        on = time < latest[of]
        seed, width, floor, weight, of, time = (x[on] for x in (seed, width, floor, weight, of, time))
    return points.reshape(sets, size)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of so many components; keys of different bands do not meet."""
    sets, size = signature.shape
    bands = signature.reshape(sets, size // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64) * GOLDEN, bands.shape[:2])
    for r in range(rows):
        key = mixed(key ^ bands[:, :, r] * np.uint64(0xC2B2AE3D27D4EB4F) + GOLDEN)
    return key.view(np.int64)


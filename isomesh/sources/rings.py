"""Rings from the ways of one area: a search over the orders in which ways can follow each other.

Helpers inside tasks; a line is a list of (node, x, y). An area of the source has 32,000 ways at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Line = list[tuple[int, float, float]]
#: Moves that the search of one area may make where ways branch, before the best that it found stands.
STEPS = 20_000
#: Pairs of sides that are held against each other at once; rings of few points go without arrays, which is quicker.
PAIRS, FEW = 100_000, 16


def few_cross(ring: Line) -> bool:
    """``crosses_itself`` for a ring of few points: all its sides against each other."""
    _, x0, y0 = ring[0]
    p = [(x - x0, y - y0) for _, x, y in ring]
    sides = list(zip(p, p[1:], strict=False))
    if len(sides) < 3 or sum(ax * by - bx * ay for (ax, ay), (bx, by) in sides) == 0:
        return True
    for i, ((ax, ay), (bx, by)) in enumerate(sides):
        ux, uy = bx - ax, by - ay
        for (cx, cy), (dx, dy) in sides[:i]:
            if (ux * (cy - ay) - uy * (cx - ax)) * (ux * (dy - ay) - uy * (dx - ax)) < 0:
                vx, vy = dx - cx, dy - cy
                if (vx * (ay - cy) - vy * (ax - cx)) * (vx * (by - cy) - vy * (bx - cx)) < 0:
                    return True
    return False


def crosses_itself(ring: Line) -> bool:
    """True if two sides of a closed ring cross, or if it has no area. A sweep by x: a side is held against those that
    begin before it ends. Sides that only touch don't cross."""
    if len(ring) <= FEW:
        return few_cross(ring)
    p = np.array([(x, y) for _, x, y in ring], dtype=float)
    p -= p[0]  # small numbers, so that products stay exact enough
    a, b = p[:-1], p[1:]
    if len(a) < 3 or np.sum(a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]) == 0:
        return True
    left, right = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    order = np.argsort(left, kind="stable")
    a, b, left, right = a[order], b[order], left[order], right[order]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    until = np.searchsorted(left, right, side="right")
    side = lambda s, t, q: (t[:, 0] - s[:, 0]) * (q[:, 1] - s[:, 1]) - (t[:, 1] - s[:, 1]) * (q[:, 0] - s[:, 0])
    # The pairs of sides, block by block: one after the other would take most of the time of small rings.
    many = until - np.arange(1, len(a) + 1)
    upto = np.cumsum(many)
    begin = 0
    while begin < len(a):
        before = upto[begin] - many[begin]
        end = max(begin + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        i = np.repeat(np.arange(begin, end), many[begin:end])
        j = np.arange(len(i)) - (upto - many)[i] + before + i + 1
        near = (low[j] <= high[i]) & (high[j] >= low[i])
        i, j = i[near], j[near]
        s, t, c, d = a[i], b[i], a[j], b[j]
        if ((side(s, t, c) * side(s, t, d) < 0) & (side(c, d, s) * side(c, d, t) < 0)).any():
            return True
        begin = end
    return False


def chained(lines: list[Line]) -> tuple[list[Line], list[Line]]:
    """(closed, open): lines joined where exactly two ends meet, which leaves no choice."""
    left = {i: line for i, line in enumerate(lines)}
    ends: dict[int, list[int]] = {}
    for i, line in left.items():
        for node in (line[0][0], line[-1][0]):
            ends.setdefault(node, []).append(i)
    closed = []
    for i in [i for i, line in left.items() if line[0][0] == line[-1][0]]:
        node = left[i][0][0]
        ends[node] = [j for j in ends[node] if j != i]
        closed.append(left.pop(i))
    for node in list(ends):
        if len(ends[node]) != 2:
            continue
        i, j = ends.pop(node)
        if i == j:  # the chain has come round
            closed.append(left.pop(i))
            continue
        one, two = left.pop(i), left.pop(j)
        one = one if one[-1][0] == node else one[::-1]
        two = two if two[0][0] == node else two[::-1]
        left[i] = one + two[1:]
        far = two[-1][0]
        ends[far][ends[far].index(j)] = i
    return closed, list(left.values())


def connected(lines: list[Line]) -> list[list[Line]]:
    """Lines that hang together by their ends, in order."""
    at: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        for node in (line[0][0], line[-1][0]):
            at.setdefault(node, []).append(i)
    seen, out = set(), []
    for first in range(len(lines)):
        if first in seen:
            continue
        seen.add(first)
        group, todo = [], [first]
        while todo:
            i = todo.pop()
            group.append(i)
            for node in (lines[i][0][0], lines[i][-1][0]):
                todo += (fresh := [j for j in dict.fromkeys(at.pop(node, [])) if j not in seen])
                seen.update(fresh)
        out.append([lines[i] for i in sorted(group)])
    return out


def searched(lines: list[Line], steps: int = STEPS) -> tuple[list[Line], list[Line]]:
    """(rings, rest) of lines that hang together: rings that pass a node once and don't cross themselves, so that as few
    lines as possible are left over.

    A walk goes on over unused lines. Where it meets itself, the loop is a ring, if it doesn't cross itself, and the walk
    goes on from there. A walk that can't go on, or a bad loop, is taken back to the last choice. A line may also be left
    over, if nothing else is left. The first way without a rest ends the search; after ``steps`` moves the best stands.
    """
    ends = [(line[0][0], line[-1][0]) for line in lines]
    at: dict[int, list[int]] = {}
    for i, (u, v) in enumerate(ends):
        at.setdefault(u, []).append(i)
        at.setdefault(v, []).append(i)
    used: set[int] = set()
    walk: list[tuple[int, int, int]] = []  # (line, from, to)
    places: dict[int, int] = {}  # node of the walk -> how many lines lead to it
    rings: list[list[tuple[int, int, int]]] = []
    rest: list[int] = []
    best: tuple[int, list, list] = (len(lines) + 1, [], list(range(len(lines))))
    first = 0  # no line before it is unused

    def drawn(loop: list[tuple[int, int, int]]) -> Line:
        out: Line = []
        for i, u, _ in loop:
            line = lines[i] if ends[i][0] == u else lines[i][::-1]
            out += line[1:] if out else line
        return out

    def options() -> list[tuple]:
        if not walk:
            i = next((i for i in range(first, len(lines)) if i not in used), None)
            return [] if i is None else [("start", i, *ends[i]), ("leave", i)]
        here = walk[-1][2]
        onward = [(i, here, ends[i][1] if ends[i][0] == here else ends[i][0]) for i in at[here] if i not in used]
        # What closes a loop goes first.
        return [("go", *o) for o in sorted(onward, key=lambda o: (o[2] not in places, o[0]))]

    def done() -> bool:
        return not walk and len(used) == len(lines)

    trail: list[tuple[list[tuple], tuple | None]] = [(options(), None)]
    while trail:
        choices, undo = trail[-1]
        if done() and len(rest) < best[0]:
            best = (len(rest), [drawn(r) for r in rings], list(rest))
            if not rest:
                break
        if not choices or steps <= 0 or len(rest) >= best[0]:
            trail.pop()
            if steps <= 0:
                break
            if undo:
                kind, i, first, removed, loop = undo
                used.discard(i)
                if kind == "leave":
                    rest.pop()
                else:
                    if loop:
                        rings.pop()
                        walk.extend(loop)
                        places.clear()
                        places.update(removed)
                    else:
                        places.pop(walk[-1][2])
                    walk.pop()
                    if kind == "start":
                        places.clear()
            continue
        steps -= 1
        kind, i, *way = choices.pop(0)
        before = first
        if kind == "leave":
            used.add(i)
            rest.append(i)
            while first in used:
                first += 1
            trail.append((options(), (kind, i, before, None, None)))
            continue
        u, v = way
        if kind == "start":
            places[u] = 0
        if v in places:
            loop = [*walk[places[v] :], (i, u, v)]
            if crosses_itself(drawn(loop)):
                continue
            kept = dict(places)
            del walk[places[v] :]
            for _, _, node in loop[:-1]:
                places.pop(node)
            rings.append(loop)
            used.add(i)
            if not walk:
                places.clear()
            undo = (kind, i, before, kept, loop)
        else:
            used.add(i)
            walk.append((i, u, v))
            places[v] = len(walk)
            undo = (kind, i, before, None, None)
        while first in used:
            first += 1
        trail.append((options(), undo))
    return best[1], [lines[i] for i in best[2]]


def rings_of(lines: list[Line]) -> tuple[list[Line], list[Line]]:
    """(closed, open) of the ways of an area; every way is in one of them, once. Ways of less than two points are none."""
    closed, left = chained([line for line in lines if len(line) > 1])
    rest = []
    for group in connected(left):
        found, over = searched(group) if len(group) > 1 else ([], group)
        closed, rest = closed + found, rest + over
    return closed, rest


def drawn(column: pa.ListArray) -> list[Line]:
    """The lines of a column of lists of (node, x, y)."""
    points = list(zip(*(part.to_pylist() for part in column.flatten().flatten()), strict=True))
    ends = column.offsets.to_pylist()
    return [points[i - ends[0] : j - ends[0]] for i, j in zip(ends, ends[1:], strict=False)]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, role, closed, ring for ways (root, role, line) that come area by area; an area holds until the next begins,
    over as many batches as it has."""

    def told(areas: list[tuple[tuple, list[Line]]]) -> pa.RecordBatch:
        rows = [(*key, done, ring) for key, ways in areas for done, rings in zip((True, False), rings_of(ways), strict=True) for ring in rings]
        ends = np.cumsum([0, *(len(ring) for *_, ring in rows)], dtype=np.int32)
        points = pa.StructArray.from_arrays([pa.array([p[k] for *_, ring in rows for p in ring], pa.float64()) for k in (1, 2)], ["x", "y"])
        kinds = (pa.int64(), pa.string(), pa.bool_())
        columns = [*(pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)), pa.ListArray.from_arrays(pa.array(ends), points)]
        return pa.RecordBatch.from_arrays(columns, ["root", "role", "closed", "ring"])

    areas: list[tuple[tuple, list[Line]]] = []
    for batch in batches:
        for *key, line in zip(batch["root"].to_pylist(), batch["role"].to_pylist(), drawn(batch["line"]), strict=True):
            if not areas or areas[-1][0] != key:
                areas.append((key, []))
            areas[-1][1].append(line)
        yield told(areas[:-1])
        del areas[:-1]
    yield told(areas)


def hull_centre(points: list[tuple[float, float]]) -> tuple[float, float]:
    """The centroid of the convex hull; of points on a line, the middle of its ends."""
    points = sorted(set(points))

    def half(way) -> list:
        out: list = []
        for q in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    if len(hull) < 3:
        return (points[0][0] + points[-1][0]) / 2, (points[0][1] + points[-1][1]) / 2
    p = np.array(hull) - hull[0]
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    centre = ((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum())
    return float(centre[0] + hull[0][0]), float(centre[1] + hull[0][1])

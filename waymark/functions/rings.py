"""Closed rings and polygons from the stretches of line that bound an area, whatever their order, direction and roles."""

from __future__ import annotations

import numpy as np

STRIP = 64  # edges in a strip of a ring, about


def segments(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spots, u, v): the distinct points, and the segments between them; one that occurs twice bounds nothing and cancels out."""
    points = np.concatenate(lines)
    spots, ids = np.unique(points[:, 0] + 1j * points[:, 1], return_inverse=True)
    within = np.ones(len(points), dtype=bool)
    within[np.cumsum([len(line) for line in lines]) - 1] = False
    at = np.flatnonzero(within)
    low, high = np.minimum(ids[at], ids[at + 1]), np.maximum(ids[at], ids[at + 1])
    codes, times = np.unique((low * len(spots) + high)[low != high], return_counts=True)
    return spots, *np.divmod(codes[times % 2 == 1], len(spots))


def without_ends(u: np.ndarray, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments without those that lead to a loose end, one after another."""
    degree = np.bincount(np.concatenate([u, v]), minlength=size)
    only = np.zeros(size, dtype=np.int64)  # where one segment is left, its number
    for ends in (u, v):
        np.bitwise_xor.at(only, ends, np.arange(len(u)))
    keep = np.ones(len(u), dtype=bool)
    loose = np.flatnonzero(degree == 1).tolist()
    while loose:
        spot = loose.pop()
        if degree[spot] != 1:
            continue
        s = only[spot]
        keep[s] = False
        for end in (u[s], v[s]):
            degree[end] -= 1
            only[end] ^= s
            if degree[end] == 1:
                loose.append(end)
    return u[keep], v[keep]


def rings(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings, as complex points, that visit no point twice and do not cross; what does not close is left out.

    Where more than two segments meet, neighbours in angle belong together, so that rings touch there.
    """
    lines = [line for line in lines if len(line) > 1]
    if not lines:
        return []
    spots, u, v = segments(lines)
    u, v = without_ends(u, v, len(spots))
    count = len(u)
    here, there = np.concatenate([u, v]), np.concatenate([v, u])
    around = np.lexsort((np.angle(spots[there] - spots[here]), here))
    nth = np.arange(2 * count) - np.searchsorted(here[around], here[around])
    last = np.append(here[around][1:] != here[around][:-1], True)
    # The next half of a segment at the same point; one without a partner leads nowhere.
    partner = np.full(2 * count, -1)
    first = (nth % 2 == 0) & ~last
    pair = np.flatnonzero(first)
    partner[around[pair]], partner[around[pair + 1]] = around[pair + 1], around[pair]
    follows = partner[(np.arange(2 * count) + count) % (2 * count)].tolist()
    at, seen, found = here.tolist(), bytearray(2 * count), []
    for start in range(count):
        if seen[start]:
            continue
        walk, half = [], start
        while half >= 0 and not seen[half]:
            seen[half] = seen[(half + count) % (2 * count)] = 1
            walk.append(at[half])
            half = follows[half]
        if half == start:
            found += simple(walk)
    return [spots[np.array([*ring, ring[0]])] for ring in found if len(ring) > 2]


def simple(walk: list[int]) -> list[list[int]]:
    """The rings of a closed walk that visit no point twice."""
    found, path, place = [], [], {}
    for spot in walk:
        if spot in place:
            k = place[spot]
            found.append(path[k:])
            for p in path[k:]:
                del place[p]
            del path[k:]
        place[spot] = len(path)
        path.append(spot)
    return [*found, path]


class Ring:
    """A closed ring with its edges in strips of y, so that a point meets few of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        x, y = points.real - points.real[0], points.imag - points.imag[0]
        self.area = abs(float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))) / 2
        self.box = points.real.min(), points.imag.min(), points.real.max(), points.imag.max()
        self._strips = self._own = None

    def strip(self, y):
        low, high = self.box[1], self.box[3]
        count = max(len(self.points) // STRIP, 1)
        return np.clip(((y - low) / (high - low or 1.0) * count).astype(np.int64), 0, count - 1)

    def holds(self, point: complex) -> bool:
        if self._strips is None:
            a, b = self.points[:-1], self.points[1:]
            low, high = self.strip(np.minimum(a.imag, b.imag)), self.strip(np.maximum(a.imag, b.imag))
            edge = np.repeat(np.arange(len(a)), high - low + 1)
            which = np.repeat(low, high - low + 1) + np.arange(len(edge)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            order = np.argsort(which, kind="stable")
            self._strips = edge[order], np.searchsorted(which[order], np.arange(which.max() + 2))
        edges, starts = self._strips
        k = int(self.strip(np.array(point.imag)))
        if k + 1 >= len(starts):
            return False
        near = edges[starts[k] : starts[k + 1]]
        a, b = self.points[near], self.points[near + 1]
        across = (a.imag > point.imag) != (b.imag > point.imag)
        a, b = a[across], b[across]
        return bool(np.count_nonzero(point.real < (b.real - a.real) * (point.imag - a.imag) / (b.imag - a.imag) + a.real) % 2)

    def contains(self, other: Ring) -> bool:
        """Whether a ring that does not cross this one lies in it; touching points say nothing, so another is asked."""
        if self._own is None:
            self._own = set(self.points.tolist())
        free = next((p for p in other.points.tolist() if p not in self._own), None)
        return self.holds((other.points[0] + other.points[1]) / 2 if free is None else free)


def polygons(lines: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Each outer ring followed by the holes in it, largest first.

    Rings nest: what lies in an even number of others is an outer ring, so that an island in a lake is land again.
    """
    found = sorted(map(Ring, rings(lines)), key=lambda r: (-r.area, r.box))
    boxes = np.array([r.box for r in found]).reshape(-1, 4)
    depth, outers = [], {}
    for k, ring in enumerate(found):
        x0, y0, x1, y1 = boxes[:k].T
        near = np.flatnonzero((x0 <= ring.box[0]) & (y0 <= ring.box[1]) & (x1 >= ring.box[2]) & (y1 >= ring.box[3]))
        around = [j for j in near.tolist() if found[j].contains(ring)]
        depth.append(len(around))
        if len(around) % 2 == 0:
            outers[k] = [ring.points]
        elif (parent := max((j for j in around if depth[j] == len(around) - 1), default=None)) in outers:
            outers[parent].append(ring.points)
    return list(outers.values())

"""The nearest lines of many points at once, in blocks of near points that share what can be nearest to them."""

from __future__ import annotations

import numpy as np

from waymark.schema import M_PER_DEG_LAT, M_PER_DEG_LON

SHARED, CELLS = 8, 1 << 17


def _offsets(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each point (rows) to the point of each segment (columns) that is nearest in degrees."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = ((x[:, None] - ax) * dx + (y[:, None] - ay) * dy) / np.where(size > 0, size, 1.0)
    t = np.where(size > 0, np.clip(along, 0.0, 1.0), 0.0)
    return ax + t * dx - x[:, None], ay + t * dy - y[:, None]


def nearest_lines(x: np.ndarray, y: np.ndarray, scale: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, line: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point a segment of its nearest line (-1 beyond the radius) and the metres.

    ``scale`` is metres a degree of longitude at each point; ``line`` numbers the segments' lines, ascending.  A line counts by its
    nearest point in degrees (the first of equals); of equally near lines the first wins.
    """
    found, metres = np.full(len(x), -1, dtype=np.int64), np.full(len(x), np.inf)
    parts = max(1, int(np.sqrt(len(x) / SHARED)))
    block = lambda v: np.minimum((v - v.min()) / max(np.ptp(v), 1e-12) * parts, parts - 1).astype(np.int64)
    of = block(x) * parts + block(y)
    order = np.argsort(of, kind="stable")
    least, most = max(min(scale.min(), M_PER_DEG_LAT), 1e-6), max(M_PER_DEG_LAT, M_PER_DEG_LON)
    for members in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        px, py = x[members], y[members]
        mx, my = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
        half = np.hypot(np.ptp(px), np.ptp(py)) / 2 * 1.000001 + 1e-9
        away = np.hypot(*(v[0] for v in _offsets(np.array([mx]), np.array([my]), ax, ay, bx, by)))
        # No line farther than this from the middle is the nearest one, or within the radius, of any member; and a line's nearest segment is among those kept.
        far = min(radius_m / least, most / least * (away.min() + half)) * 1.000001 + half
        kept = np.flatnonzero(away <= far)
        if not len(kept):
            continue
        starts = np.flatnonzero(np.r_[True, np.diff(line[kept]) != 0])
        step = max(1, CELLS // len(kept))
        for low in range(0, len(members), step):
            rows = members[low : low + step]
            ox, oy = _offsets(x[rows], y[rows], ax[kept], ay[kept], bx[kept], by[kept])
            east, north = ox * scale[rows, None], oy * M_PER_DEG_LAT
            far_m = np.sqrt(east * east + north * north)
            segment = np.broadcast_to(kept, far_m.shape)
            if len(starts) < len(kept):
                degrees = ox * ox + oy * oy
                lowest = np.repeat(np.minimum.reduceat(degrees, starts, axis=1), np.diff(np.r_[starts, len(kept)]), axis=1)
                place = np.where(degrees == lowest, np.arange(len(kept)), len(kept))
                pick = np.minimum.reduceat(place, starts, axis=1)
                far_m, segment = np.take_along_axis(far_m, pick, 1), kept[pick]
            best = far_m.argmin(axis=1)
            every = np.arange(len(rows))
            near = far_m[every, best]
            good = near <= radius_m
            found[rows[good]], metres[rows[good]] = segment[every, best][good], near[good]
    return found, metres

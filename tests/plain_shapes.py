"""Validity and disjointness of shapes edge by edge, as a plain reference for the operators."""

import numpy as np

_BLOCK = 2048  # edges compared per NumPy block, so memory stays linear in the ring size


def _edges(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edges (x0, y0, x1, y1, ring number) of flattened rings."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    same = ring[:-1] == ring[1:]
    return np.column_stack([xs[:-1], ys[:-1], xs[1:], ys[1:], ring[:-1]])[same]


def _side(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _touching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix telling which edges of ``a`` share at least a position with which of ``b``."""
    ax0, ay0, ax1, ay1 = (a[:, i, None] for i in range(4))
    bx0, by0, bx1, by1 = (b[None, :, i] for i in range(4))
    d1, d2 = _side(bx0, by0, bx1, by1, ax0, ay0), _side(bx0, by0, bx1, by1, ax1, ay1)
    d3, d4 = _side(ax0, ay0, ax1, ay1, bx0, by0), _side(ax0, ay0, ax1, ay1, bx1, by1)
    boxes = (
        (np.maximum(ax0, ax1) >= np.minimum(bx0, bx1))
        & (np.maximum(bx0, bx1) >= np.minimum(ax0, ax1))
        & (np.maximum(ay0, ay1) >= np.minimum(by0, by1))
        & (np.maximum(by0, by1) >= np.minimum(ay0, ay1))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def _covers(edges: np.ndarray, x: float, y: float) -> bool:
    """Even-odd test of one position against all edges of a polygon."""
    spans = (edges[:, 1] > y) != (edges[:, 3] > y)
    e = edges[spans]
    at = e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    return bool(np.count_nonzero(x < at) % 2)


def valid_polygon(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> bool:
    """Rings closed, with area, not crossing themselves or each other; holes inside their shell."""
    if not (np.isfinite(xs).all() and np.isfinite(ys).all()):
        return False
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for start, size in zip(starts, sizes, strict=True):
        rx, ry = xs[start : start + size], ys[start : start + size]
        if size < 4 or rx[0] != rx[-1] or ry[0] != ry[-1]:
            return False
        ox, oy = rx - rx[0], ry - ry[0]
        if np.sum(ox[:-1] * oy[1:] - ox[1:] * oy[:-1]) == 0:
            return False
    edges = _edges(xs, ys, sizes)
    edges = edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]
    n = len(edges)
    ring = edges[:, 4].astype(int)
    last_of_ring = np.append(ring[1:] != ring[:-1], True)
    first = {r: i for i, r in reversed(list(enumerate(ring)))}
    following = np.where(last_of_ring, [first[r] for r in ring], np.arange(n) + 1)
    for low in range(0, n, _BLOCK):
        rows = np.arange(low, min(low + _BLOCK, n))
        hit = _touching(edges[rows], edges)
        hit &= np.arange(n)[None, :] > rows[:, None]
        i, j = np.nonzero(hit)
        i = rows[i]
        for a, b in zip(i, j, strict=True):
            neighbours = following[a] == b or following[b] == a
            if neighbours and ring[a] == ring[b]:
                first_edge, next_edge = (a, b) if following[a] == b else (b, a)
                if _folds_back(edges[first_edge], edges[next_edge]):
                    return False
            elif ring[a] == ring[b] or not _meets_at_vertex(edges[a], edges[b]):
                return False
    return _nested(xs, ys, sizes, owners, starts)


def _folds_back(e: np.ndarray, f: np.ndarray) -> bool:
    """Consecutive edges overlapping beyond their shared vertex."""
    ux, uy, vx, vy = e[2] - e[0], e[3] - e[1], f[2] - f[0], f[3] - f[1]
    return ux * vy - uy * vx == 0 and ux * vx + uy * vy < 0


def _meets_at_vertex(a: np.ndarray, b: np.ndarray) -> bool:
    """Edges of two rings may share one vertex position but must not cross or overlap."""
    da, db = _side(*b[:4], a[0], a[1]), _side(*b[:4], a[2], a[3])
    dc, dd = _side(*a[:4], b[0], b[1]), _side(*a[:4], b[2], b[3])
    crossing = da * db < 0 and dc * dd < 0
    overlapping = da == 0 and db == 0 and dc == 0 and dd == 0
    if overlapping:
        ends = {(a[0], a[1]), (a[2], a[3])} & {(b[0], b[1]), (b[2], b[3])}
        along = (a[2] - a[0]) * (b[2] - b[0]) + (a[3] - a[1]) * (b[3] - b[1])
        shared_end_only = len(ends) == 1 and _apart(a, b, next(iter(ends)), along)
        return shared_end_only
    return not crossing


def _apart(a: np.ndarray, b: np.ndarray, at: tuple[float, float], along: float) -> bool:
    """Collinear edges sharing one end point away from each other."""
    far_a = (a[2], a[3]) if (a[0], a[1]) == at else (a[0], a[1])
    far_b = (b[2], b[3]) if (b[0], b[1]) == at else (b[0], b[1])
    return (far_a[0] - at[0]) * (far_b[0] - at[0]) + (far_a[1] - at[1]) * (far_b[1] - at[1]) < 0


def _nested(xs, ys, sizes, owners, starts) -> bool:
    """Holes lie in their own shell and in no sibling hole; shells of other parts do not overlap."""
    per_ring = [
        _edges(xs[s : s + n], ys[s : s + n], np.array([n])) for s, n in zip(starts, sizes, strict=True)
    ]
    shells = [i for i in range(len(sizes)) if i == 0 or owners[i] != owners[i - 1]]
    for r in range(len(sizes)):
        for other in range(len(sizes)):
            if other == r:
                continue
            same_part = owners[r] == owners[other]
            is_inside = _ring_inside(per_ring[r], per_ring[other])
            if r in shells:
                if other in shells and is_inside and not _in_hole(r, other, owners, shells, per_ring):
                    return False
            elif same_part and (is_inside != (other in shells)):
                return False
    return True


def _in_hole(r: int, shell: int, owners, shells, per_ring) -> bool:
    holes = [h for h in range(len(owners)) if owners[h] == owners[shell] and h not in shells]
    return any(_ring_inside(per_ring[r], per_ring[h]) for h in holes)


def _ring_inside(inner: np.ndarray, outer: np.ndarray) -> bool:
    """Whether a ring that does not cross ``outer`` lies in it, judged off its border."""
    on_border = set(map(tuple, outer[:, :2]))
    for x, y in inner[:, :2]:
        if (x, y) not in on_border:
            return _covers(outer, x, y)
    mid = inner[:, :2] + (inner[:, 2:4] - inner[:, :2]) / 2
    return _covers(outer, *mid[0])


def apart_from(xs, ys, sizes, areal: bool, outline: np.ndarray) -> bool:
    xs, ys = np.asarray(xs), np.asarray(ys)
    if len(xs) == 0:
        return True
    if (
        xs.max() < outline[:, [0, 2]].min()
        or xs.min() > outline[:, [0, 2]].max()
        or ys.max() < outline[:, [1, 3]].min()
        or ys.min() > outline[:, [1, 3]].max()
    ):
        return True
    own = _edges(xs, ys, sizes)
    if len(own) == 0:  # points only
        return not any(
            _covers(outline, x, y) or _touching(np.array([[x, y, x, y]]), outline).any()
            for x, y in zip(xs, ys, strict=True)
        )
    for low in range(0, len(own), _BLOCK):
        if _touching(own[low : low + _BLOCK], outline).any():
            return False
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    if any(_covers(outline, xs[s], ys[s]) for s in starts):
        return False
    return not (areal and _covers(own, outline[0, 0], outline[0, 1]))

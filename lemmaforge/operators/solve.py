"""Small exact-vertex solvers, NumPy only: fixed-dimension linear programs and planar hulls."""

from __future__ import annotations

import numpy as np

#: Of scaled points: distance from a plane that counts as on it, and extent that counts as none.
_FLAT, _THIN = 1e-10, 1e-8


def lp(rows: np.ndarray, least: np.ndarray, cost: np.ndarray, box: np.ndarray, tol: float = 1e-9, most: int = 5000) -> tuple[np.ndarray, np.ndarray] | None:
    """Minimise cost·x over rows·x >= least and |x_j| <= box_j.

    Dual simplex from the box's corner that minimises the cost: in each step
    the most violated row enters (after many steps the first one), so the
    number of rows counts only through one matrix product a step.  Returns x
    and the rows (of ``rows``) in the final basis, or None if infeasible.
    """
    d = len(cost)
    a = np.vstack([rows, np.eye(d), -np.eye(d)])
    b = np.concatenate([least, -box, -box])
    scale = 1.0 + np.abs(b)
    m = len(rows)
    basis = np.array([m + j if cost[j] >= 0 else m + d + j for j in range(d)])
    for step in range(most):
        mat = a[basis]
        try:
            x = np.linalg.solve(mat, b[basis])
            lam = np.linalg.solve(mat.T, cost)
        except np.linalg.LinAlgError:
            return None
        gap = (b - a @ x) / scale
        gap[basis] = 0.0
        k = int(np.argmax(gap)) if step < most // 2 else int(np.argmax(gap > tol))
        if gap[k] <= tol:
            return x, basis[basis < m]
        u = np.linalg.solve(mat.T, a[k])
        ok = u > 1e-11
        if not ok.any():
            return None
        ratio = np.where(ok, np.maximum(lam, 0.0) / np.where(ok, u, 1.0), np.inf)
        low = ratio.min()
        out = min(np.flatnonzero(ratio <= low + 1e-14), key=lambda i: basis[i])
        basis[out] = k
    return None


def hull(points: np.ndarray, upper: bool) -> np.ndarray:
    """Vertices of the upper or lower hull of planar points, by x, without collinear ones."""
    if not len(points):
        return points
    sign = 1.0 if upper else -1.0
    p = points[np.lexsort((-sign * points[:, 1], points[:, 0]))]
    p = p[np.append(True, np.diff(p[:, 0]) > 0)]
    out: list[np.ndarray] = []
    for q in p:
        while len(out) > 1 and sign * ((out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0])) >= 0:
            out.pop()
        out.append(q)
    return np.array(out)


def _turned(p: np.ndarray, normal: np.ndarray, at: np.ndarray, axis: np.ndarray) -> np.ndarray | None:
    """The supporting plane's normal turned from ``normal`` towards ``axis`` around the points ``at`` up to the first other point."""
    s, u = (p[at[0]] - p) @ normal, (p - p[at[0]]) @ axis
    off = s > _FLAT
    if not off.any():
        return None
    angle = np.arctan2(s[off], u[off]).min()
    out = np.cos(angle) * normal + np.sin(angle) * axis
    return out / np.linalg.norm(out)


def _on(p: np.ndarray, normal: np.ndarray) -> np.ndarray:
    v = p @ normal
    return np.flatnonzero(v >= v.max() - _FLAT)


def _span(p: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the differences of the points."""
    _, size, v = np.linalg.svd(p - p[0], full_matrices=False)
    return v[size > _THIN]


def wrapped(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Facets (outward normal, positions of all points on it) of full-dimensional points: gift wrapping over ridges."""
    n, d = p.shape
    if d == 1:
        return [(np.array([1.0]), _on(p, np.array([1.0]))), (np.array([-1.0]), _on(p, np.array([-1.0])))]
    normal = np.eye(d)[0]
    on = _on(p, normal)
    while len(span := _span(p[on])) < d - 1:
        free = np.linalg.svd(np.vstack([normal, span]))[2][len(span) + 1]
        wide = (p - p[on[0]]) @ free
        turned = _turned(p, normal, on, free if wide.max() > -wide.min() else -free)
        more = _on(p, turned)
        if len(_span(p[more])) <= len(span):
            break
        normal, on = turned, more
    found = {frozenset(on.tolist()): (normal, on)}
    todo = [(normal, on)]
    while todo:
        normal, on = todo.pop()
        span = _span(p[on])
        if len(span) != d - 1:
            continue
        for outward, part in wrapped((p[on] - p[on[0]]) @ span.T):
            turned = _turned(p, normal, on[part], outward @ span)
            if turned is None:
                continue
            more = _on(p, turned)
            if (key := frozenset(more.tolist())) not in found:
                found[key] = (turned, more)
                todo.append(found[key])
    return list(found.values())


def facets(points: np.ndarray, tol: float = 1e-8) -> list[tuple[np.ndarray, float, bool]]:
    """Facets of the hull of points (x.., y) as (w, b, upper): y <= w·x + b or y >= w·x + b.  Side facets are left out.

    The points should be reduced first.  Planar by monotone chain; in space by
    gift wrapping: from a first facet over every ridge to its other facet,
    until no new facet turns up.  A facet is known by all the points on it, so
    facets that are no simplices are found once, with their ridges by the same
    method one dimension below.
    """
    d = points.shape[1] - 1
    out: list[tuple[np.ndarray, float, bool]] = []
    if d == 1:
        for upper in (True, False):
            h = hull(points, upper)
            for p, q in zip(h[:-1], h[1:], strict=True):
                w = (q[1] - p[1]) / (q[0] - p[0])
                out.append((np.array([w]), float(p[1] - w * p[0]), upper))
        return out
    x, y = points[:, :-1], points[:, -1]
    rows = np.hstack([x, np.ones((len(x), 1))])
    if not len(x) or np.linalg.matrix_rank(rows / np.maximum(np.abs(rows).max(axis=0), 1e-300), tol=1e-9) < d + 1:
        return out
    low, wide = points.min(axis=0), np.ptp(points, axis=0)
    p, first = np.unique((points - low) / np.where(wide > 0, wide, 1.0), axis=0, return_index=True)
    if len(_span(p)) == d + 1:
        sides = [(on, normal[-1]) for normal, on in wrapped(p) if abs(normal[-1]) > _FLAT]
    else:  # all points on one plane
        sides = [(np.arange(len(p)), 1.0), (np.arange(len(p)), -1.0)]
    for on, side in sides:
        own = first[on]
        spread = x[own] - x[own[0]]
        if np.linalg.matrix_rank(spread / np.where(wide[:-1] > 0, wide[:-1], 1.0), tol=1e-9) < d:
            continue
        w = np.linalg.lstsq(spread / wide[:-1], y[own] - y[own[0]], rcond=None)[0] / wide[:-1]
        out.append((w, float(y[own[0]] - w @ x[own[0]]), bool(side > 0)))
    out.sort(key=lambda f: (not f[2], *f[0].tolist(), f[1]))
    return out

"""Convex hulls of distributed points: the farthest row beyond each facet, pass by pass.

The driver holds facets and the corners that span them.  A pass gives every
row the facet that it lies farthest beyond, ``max_by`` keeps the farthest row
of each facet, and these become corners of the next hull; rows inside are out
of later passes, as a hull only grows.  The farthest row in a facet's direction
lies on the hull, so passes end when no row is beyond any facet: then all rows
are in the hull of the corners, and that is theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import solve

Key = Hashable
#: Of points scaled to the corners' extents: distance beyond a facet that counts.
BEYOND = 1e-9
#: Rows compared with all facets at once.
CHUNK = 4_000


def _extremes(points: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The rows of least and largest value of each coordinate; of equal ones the least row."""
    row = F.struct(*names)
    least = [F.min(F.struct(n, row.alias("row"))).alias(f"a{i}") for i, n in enumerate(names)]
    largest = [F.min(F.struct((-F.col(n)).alias("less"), row.alias("row"))).alias(f"b{i}") for i, n in enumerate(names)]
    got = points.agg(*least, *largest).first()
    return np.array([list(x["row"]) for x in got if x is not None], float).reshape(-1, len(names))


def _farthest(points: DataFrame, names: Sequence[str], normals: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """The row farthest beyond each plane normal·x > offset, and the rows that are beyond any."""
    kind = ", ".join(f"{n} double" for n in names)

    def beyond(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            for lo in range(0, len(x), CHUNK):
                part = x[lo : lo + CHUNK]
                gaps = part @ normals.T - offsets
                at = gaps.argmax(axis=1)
                gap = gaps[np.arange(len(part)), at]
                out = gap > 0
                yield pd.DataFrame(part[out], columns=list(names)).assign(facet=at[out], gap=gap[out])

    outside = points.select(*names).mapInPandas(beyond, f"{kind}, facet int, gap double")
    # one row for each facet; equally far ones by their coordinates
    best = outside.groupBy("facet").agg(F.max_by(F.struct(*names), F.struct("gap", *names)).alias("p")).collect()
    return np.array([list(r["p"]) for r in best], float).reshape(-1, len(names)), outside.select(*names)


def _flat_normals(corners: np.ndarray, low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Both directions of every axis that the scaled corners do not extend in, in unscaled coordinates."""
    p = (corners - low) / wide
    d = p.shape[1]
    span = np.linalg.svd(p - p[0], full_matrices=True)
    rank = int((span[1] > 1e-8).sum())
    free = span[2][rank:] if rank < d else np.empty((0, d))
    return np.vstack([free, -free]) / wide


def planes(held: np.ndarray, slack: float = BEYOND) -> tuple[np.ndarray, np.ndarray, bool]:
    """Normals and offsets of the planes that the corners' hull lies below, and whether the corners span space.

    Where they do not, the planes are those on both sides of what they span.
    """
    low, wide = held.min(axis=0), np.ptp(held, axis=0)
    wide = np.where(wide > 0, wide, np.maximum(1.0, np.abs(low)))
    flat = _flat_normals(held, low, wide)
    if len(flat):
        return flat, flat @ held[0] + 10 * slack, False
    scaled = (held - low) / wide
    if held.shape[1] == 1:
        found = [(np.array([1.0]), scaled.max()), (np.array([-1.0]), -scaled.min())]
    else:
        found = [(n, (scaled[on] @ n).max()) for n, on in solve.wrapped(scaled)]
    normals = np.array([n for n, _ in found]) / wide
    return normals, np.array([b for _, b in found]) + normals @ low + slack, True


def corners(points: DataFrame, start: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``points`` (finite double columns) and of ``start`` that have the same hull as all of them.

    ``start`` are corners of a hull known before: where no row is beyond it,
    they come back as they are after one pass.  Of rows that lie on one plane
    (less than space) come some that span it, not the corners within it.
    """
    names = points.columns
    d = len(names)
    held = np.unique(np.vstack([x for x in (start, _extremes(points, names) if start is None or not len(start) else None) if x is not None]).reshape(-1, d), axis=0)
    if not len(held):
        return held
    kept: list[DataFrame] = []
    rest = points
    while True:
        normals, offsets, spanned = planes(held)
        new, outside = _farthest(rest, names, normals, offsets)
        more = np.unique(np.vstack([held, new]), axis=0)
        if len(more) == len(held):
            for x in kept:
                x.unpersist()
            return held
        held = more
        if spanned:  # rows inside stay inside
            rest = outside.persist()
            kept.append(rest)


def corners_many(rows: DataFrame, points_of: Callable[[pd.DataFrame, Key], np.ndarray], sizes: Mapping[Key, int], start: Mapping[Key, np.ndarray]) -> dict[Key, np.ndarray]:
    """``corners`` of many sets of points at once: a pass for all of them, until none has a row beyond a facet.

    ``points_of(frame, key)`` are a set's points in some rows, of as many
    columns as ``sizes`` says; ``start`` has corners known before.  A task hands
    on the farthest row beyond each facet, so its result has no more rows than
    there are facets.
    """
    held = {k: start.get(k, np.empty((0, d))) for k, d in sizes.items()}
    open_ = list(sizes)
    while open_:
        now = []
        for k in open_:
            d = sizes[k]
            # without corners: the farthest along every axis
            now.append((np.vstack([np.eye(d), -np.eye(d)]), np.full(2 * d, -np.inf)) if not len(held[k]) else planes(held[k])[:2])

        def farthest(frames: Iterable[pd.DataFrame], now=now, keys=tuple(open_)) -> Iterable[pd.DataFrame]:
            best: dict[tuple[int, int], tuple[float, list[float]]] = {}
            for frame in frames:
                for i, k in enumerate(keys):
                    points = points_of(frame, k)
                    for lo in range(0, len(points), CHUNK):
                        gaps = points[lo : lo + CHUNK] @ now[i][0].T - np.maximum(now[i][1], -1e300)
                        at = gaps.argmax(axis=0)
                        for f in np.flatnonzero(gaps.max(axis=0) > 0):
                            found = (float(gaps[at[f], f]), points[lo + at[f]].tolist())
                            best[i, int(f)] = max(found, best.get((i, int(f)), found))
            yield pd.DataFrame([(i, f, g, p) for (i, f), (g, p) in best.items()], columns=["i", "f", "gap", "p"])

        found = rows.mapInPandas(farthest, "i int, f int, gap double, p array<double>").groupBy("i", "f").agg(F.max_by("p", F.struct("gap", "p")).alias("p")).collect()
        new: dict[Key, list] = {}
        for r in found:
            new.setdefault(open_[r["i"]], []).append(r["p"])
        open_ = []
        for k, points in new.items():
            more = np.unique(np.vstack([held[k], np.array(points, float).reshape(-1, sizes[k])]), axis=0)
            if len(more) > len(held[k]):
                held[k] = more
                open_.append(k)
    return held

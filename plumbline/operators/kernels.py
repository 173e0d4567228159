"""Numeric kernels of one room: polygons, rasters, clearances and widest paths, run per room by Spark.

A room is bounded by its floor area over the cell size; rooms are many. Kernels are pure functions of arrays, and
`per_room` runs one over every group of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Cells of the raster, stop exemption and its share of a leg: fixed values.
CELL, STOP_RADIUS, STOP_SHARE = 0.025, 0.75, 0.35
_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def per_room(rows: DataFrame, room: str, kernel: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per room: the room's key and what the kernel finds in its rows."""
    kind = rows.schema[room].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernel(pdf)
        return pd.DataFrame([[key[0], *[found.get(n) for n in names]]], columns=[room, *names])

    return rows.groupBy(room).applyInPandas(run, f"{room} {kind}, {schema}")


def corners(cx: float, cy: float, half_x: float, half_y: float, angle: float) -> np.ndarray:
    """The four corners of a rotated rectangle, counter-clockwise."""
    c, s = np.cos(angle), np.sin(angle)
    local = np.array([[-half_x, -half_y], [half_x, -half_y], [half_x, half_y], [-half_x, half_y]])
    return local @ np.array([[c, s], [-s, c]]) + [cx, cy]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, from the lowest x; collinear points left out."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(some) -> list:
        out: list = []
        for q in some:
            while len(out) > 1 and _cross(out[-1] - out[-2], q - out[-1]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _cross(a: np.ndarray, b: np.ndarray) -> float:
    return float(a[0] * b[1] - a[1] * b[0])


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex counter-clockwise window."""
    out = [p for p in np.asarray(subject, float)]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        edge, before, out = b - a, out, []
        side = [_cross(edge, p - a) for p in before]
        for i, p in enumerate(before):
            j = i - 1
            if (side[i] >= 0) != (side[j] >= 0):
                t = side[j] / (side[j] - side[i])
                out.append(before[j] + t * (p - before[j]))
            if side[i] >= 0:
                out.append(p)
        if not out:
            return np.empty((0, 2))
    return np.array(out)


def polygon_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance between two convex polygons, 0 where they touch or overlap."""
    if len(clip(a, b)):
        return 0.0
    best = np.inf
    for p, q in ((a, b), (b, a)):
        s, e = q, np.roll(q, -1, axis=0)
        d = e - s
        t = np.clip(((p[:, None] - s) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        best = min(best, float(np.linalg.norm(p[:, None] - (s + t[..., None] * d), axis=2).min()))
    return best


def least_gap(polygons: list[np.ndarray]) -> float | None:
    """The least gap between two of the convex polygons; none with fewer than two.

    They go by where they begin; a pair whose bounds are as far apart as the best pair so far isn't measured.
    """
    if len(polygons) < 2:
        return None
    low, high = np.array([p.min(0) for p in polygons]), np.array([p.max(0) for p in polygons])
    order = np.argsort(low[:, 0], kind="stable")
    best = np.inf
    for at, i in enumerate(order[:-1]):
        after = order[at + 1 : at + 1 + np.searchsorted(low[order[at + 1 :], 0], high[i, 0] + best)]
        apart = np.linalg.norm(np.maximum(0, np.maximum(low[after] - high[i], low[i] - high[after])), axis=1)
        nearest = np.argsort(apart, kind="stable")
        for j, bound in zip(after[nearest], apart[nearest], strict=True):
            if bound >= best:
                break
            best = min(best, polygon_gap(polygons[max(i, j)], polygons[min(i, j)]))
            if best == 0:
                return 0.0
    return float(best)


def rasterise(width: float, depth: float, boxes: np.ndarray, cell: float = CELL) -> np.ndarray:
    """Owner of each cell of a floor from 0, 0: the index of the first box (cx, cy, half_x, half_y, angle) over its centre, or -1."""
    rows, cols = max(1, round(depth / cell)), max(1, round(width / cell))
    y, x = np.mgrid[0:rows, 0:cols]
    x, y = (x + 0.5) * cell, (y + 0.5) * cell
    owner = np.full((rows, cols), -1, np.int32)
    for i in range(len(boxes) - 1, -1, -1):
        cx, cy, hx, hy, angle = boxes[i]
        c, s = np.cos(angle), np.sin(angle)
        u, v = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
        owner[(np.abs(u) <= hx) & (np.abs(v) <= hy)] = i
    return owner


def clearance(free: np.ndarray, cell: float = CELL) -> np.ndarray:
    """Distance of each free cell's centre to the nearest blocked one, the border counting as blocked; exact."""
    padded = np.pad(free, 1)
    far = float(sum(padded.shape)) ** 2
    g = np.where(padded, far, 0.0)
    for axis in (0, 1):
        g = np.apply_along_axis(_lower_envelope, axis, g)
    return (np.sqrt(g) * cell)[1:-1, 1:-1] * free


def _lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)**2 + f[q], for every p, from the lower envelope of parabolas."""
    n, k = len(f), 0
    place, bound = np.zeros(n, int), np.empty(n + 1)
    bound[0], bound[1] = -np.inf, np.inf
    for q in range(1, n):
        while True:
            s = (f[q] + q * q - f[place[k]] - place[k] ** 2) / (2 * (q - place[k]))
            if s > bound[k]:
                break
            k -= 1
        k += 1
        place[k], bound[k], bound[k + 1] = q, s, np.inf
    at = place[np.searchsorted(bound[1 : k + 1], np.arange(n), side="left")]
    return (np.arange(n) - at) ** 2 + f[at]


def exempt(shape: tuple[int, int], stops: list[tuple[int, int]], cell: float) -> np.ndarray:
    """Cells near a stop, where a leg's width isn't judged: at most a share of the leg."""
    leg = np.hypot(*np.subtract(stops[0], stops[-1])) * cell
    radius = min(STOP_RADIUS, STOP_SHARE * leg)
    r, c = np.mgrid[0 : shape[0], 0 : shape[1]]
    return np.logical_or.reduce([np.hypot(r - a, c - b) * cell <= radius for a, b in stops])


def widest_path(room: np.ndarray, start: tuple[int, int], goal: tuple[int, int], free_of: np.ndarray | None = None) -> tuple[float, list[tuple[int, int]]]:
    """The path over free cells (room: clearance of each, 0 where blocked) whose least clearance is largest.

    Eight neighbours; cells of free_of don't limit the width. On ties the smaller flat index comes first. Gives
    (0.0, []) where no path is.
    """
    rows, cols = room.shape
    worth = np.where((room > 0) & (free_of if free_of is not None else False), np.inf, room)
    best, came = np.zeros(room.shape), {}
    if room[start] <= 0 or room[goal] <= 0:
        return 0.0, []
    best[start] = worth[start]
    heap = [(-best[start], start[0] * cols + start[1])]
    while heap:
        w, flat = heapq.heappop(heap)
        at = divmod(flat, cols)
        if -w < best[at]:
            continue
        if at == goal:
            path = [at]
            while path[-1] != start:
                path.append(came[path[-1]])
            return float(best[goal]), path[::-1]
        for dr, dc in _STEPS:
            to = (at[0] + dr, at[1] + dc)
            if 0 <= to[0] < rows and 0 <= to[1] < cols and room[to] > 0:
                width = min(best[at], worth[to])
                if width > best[to]:
                    best[to], came[to] = width, at
                    heapq.heappush(heap, (-width, to[0] * cols + to[1]))
    return 0.0, []


def labels(free: np.ndarray) -> np.ndarray:
    """Connected components of free cells over eight neighbours, from 1 in order of the first cell; 0 where blocked."""
    out, n = np.zeros(free.shape, np.int32), 0
    for r, c in zip(*np.nonzero(free), strict=True):
        if out[r, c]:
            continue
        n += 1
        out[r, c] = n
        stack = [(r, c)]
        while stack:
            a, b = stack.pop()
            for dr, dc in _STEPS:
                x, y = a + dr, b + dc
                if 0 <= x < free.shape[0] and 0 <= y < free.shape[1] and free[x, y] and not out[x, y]:
                    out[x, y] = n
                    stack.append((x, y))
    return out


def largest_square(free: np.ndarray, cell: float = CELL) -> float:
    """Side of the largest axis-aligned square of free cells."""
    size = np.zeros((free.shape[0] + 1, free.shape[1] + 1), int)
    for r in range(free.shape[0]):
        for c in range(free.shape[1]):
            if free[r, c]:
                size[r + 1, c + 1] = 1 + min(size[r, c], size[r, c + 1], size[r + 1, c])
    return float(size.max() * cell)


def blockers(owner: np.ndarray, room: np.ndarray, path: list[tuple[int, int]]) -> list[int]:
    """The owners nearest to the narrowest cell of a path: at most two, nearest first."""
    if not path:
        return []
    pinch = min(path, key=lambda p: (room[p], p))
    r, c = np.nonzero(owner >= 0)
    d = np.hypot(r - pinch[0], c - pinch[1])
    out: list[int] = []
    for i in np.lexsort((owner[r, c], d)):
        if int(owner[r[i], c[i]]) not in out:
            out.append(int(owner[r[i], c[i]]))
        if len(out) == 2:
            break
    return out


def ray_box(origin: np.ndarray, direction: np.ndarray, low: np.ndarray, high: np.ndarray) -> float | None:
    """Distance along a ray to an axis box, or None."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t1, t2 = (low - origin) / direction, (high - origin) / direction
    near, far = np.nanmax(np.minimum(t1, t2)), np.nanmin(np.maximum(t1, t2))
    return float(max(near, 0.0)) if far >= max(near, 0.0) else None


def isovist(centre: np.ndarray, segments: np.ndarray, rays: int = 180, most: float = 20.0) -> float:
    """Area seen from a point: sectors to the nearest segment (x1, y1, x2, y2) hit by each ray, at most `most` away."""
    step = 2 * np.pi / rays
    angle = np.arange(rays) * step
    d = np.stack([np.cos(angle), np.sin(angle)], 1)[:, None]
    nearest = np.full(rays, most)
    for first in range(0, len(segments), 4096):  # many segments are looked at some at a time
        some = segments[first : first + 4096]
        a, e = some[None, :, :2] - centre, (some[:, 2:] - some[:, :2])[None]
        cross = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (a[..., 0] * e[..., 1] - a[..., 1] * e[..., 0]) / cross
            u = (a[..., 0] * d[..., 1] - a[..., 1] * d[..., 0]) / cross
        hit = np.where((np.abs(cross) > 1e-12) & (t >= 0) & (u >= 0) & (u <= 1), t, most)
        nearest = np.minimum(nearest, hit.min(1))
    return float((0.5 * nearest**2 * step).sum())

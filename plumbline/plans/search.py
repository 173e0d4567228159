"""Bounded search for better layouts of one room, and checks that need a search: run per room by Spark.

A room's pieces are rows (piece, cx, cy, half_x, half_y, angle, movable). Candidates come in a fixed order, least
disruptive first, and the first that keeps every hard constraint and widens the route enough is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from plumbline.functions.exprs import INCH
from plumbline.operators import kernels as K

#: Steps of a move in inches, and the least gain in inches that counts: fixed values.
STEPS, LEAST_GAIN = (2, 4, 6, 9, 12, 18, 24), 1.0
_ALONG = [(np.cos(a), np.sin(a)) for a in np.arange(8) * np.pi / 4]


def route_width(boxes: np.ndarray, room: tuple[float, float], cell: float, stops: list[tuple[float, float]]) -> float:
    """Clear width in metres of the widest route between the first and the last stop; 0 where none is."""
    free = K.rasterise(*room, boxes, cell) < 0
    clear = K.clearance(free, cell)
    at = [(min(int(y / cell), free.shape[0] - 1), min(int(x / cell), free.shape[1] - 1)) for x, y in stops]
    width, _ = K.widest_path(clear, at[0], at[-1], free_of=K.exempt(clear.shape, at, cell))
    return 2 * width if np.isfinite(width) else float(min(room))


def candidates(boxes: np.ndarray, which: list[int], limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(piece, new boxes): each named piece in eight directions, the smallest steps first; at most `limit`."""
    made = 0
    for step in STEPS:
        for i in which:
            for dx, dy in _ALONG:
                if made == limit:
                    return
                new = boxes.copy()
                new[i, 0] += dx * step * INCH
                new[i, 1] += dy * step * INCH
                made += 1
                yield i, new


def legal(boxes: np.ndarray, moved: int, room: tuple[float, float]) -> bool:
    """Whether the moved piece stays on the floor and touches no other that it didn't touch."""
    own = K.corners(*boxes[moved])
    if own.min() < 0 or own[:, 0].max() > room[0] or own[:, 1].max() > room[1]:
        return False
    return all(K.polygon_gap(own, K.corners(*b)) > 0 for j, b in enumerate(boxes) if j != moved)


def widen(pieces: pd.DataFrame, room: tuple[float, float], cell: float, stops: list[tuple[float, float]], limit: int = 24) -> dict:
    """The first legal move of a movable piece at the route's pinch that widens it by LEAST_GAIN inches.

    Gives before and after in inches, the piece and its shift; piece is None where no candidate passes.
    """
    rows = pieces.sort_values("piece")
    boxes = rows[["cx", "cy", "half_x", "half_y", "angle"]].to_numpy(float)
    owner = K.rasterise(*room, boxes, cell)
    clear = K.clearance(owner < 0, cell)
    at = [(min(int(y / cell), owner.shape[0] - 1), min(int(x / cell), owner.shape[1] - 1)) for x, y in stops]
    _, path = K.widest_path(clear, at[0], at[-1], free_of=K.exempt(clear.shape, at, cell))
    before = route_width(boxes, room, cell, stops)
    pinching = K.blockers(owner, clear, path) or list(range(len(boxes)))
    movable = rows["movable"].to_numpy(bool)
    out = {"before": round(before / INCH, 6), "after": round(before / INCH, 6), "piece": None, "dx": 0.0, "dy": 0.0}
    for i, new in candidates(boxes, [i for i in pinching if movable[i]], limit):
        if legal(new, i, room) and (after := route_width(new, room, cell, stops)) >= before + LEAST_GAIN * INCH:
            shift = (new[i, :2] - boxes[i, :2]) / INCH
            return out | {"after": round(after / INCH, 6), "piece": int(rows["piece"].iloc[i]), "dx": round(shift[0], 6), "dy": round(shift[1], 6)}
    return out


def place_along_walls(boxes: np.ndarray, size: tuple[float, float], room: tuple[float, float], step: float = 0.25) -> tuple[float, float] | None:
    """The first centre, walking along the walls from the corner, where a box of this size stands free; else None."""
    hx, hy = size[0] / 2, size[1] / 2
    xs, ys = np.arange(hx, room[0] - hx + 1e-9, step), np.arange(hy, room[1] - hy + 1e-9, step)
    ring = [(x, hy) for x in xs] + [(room[0] - hx, y) for y in ys] + [(x, room[1] - hy) for x in xs[::-1]] + [(hx, y) for y in ys[::-1]]
    for x, y in ring:
        if legal(np.vstack([boxes, [x, y, hx, hy, 0.0]]) if len(boxes) else np.array([[x, y, hx, hy, 0.0]]), len(boxes), room):
            return float(x), float(y)
    return None


def approach(boxes: np.ndarray, which: int, room: tuple[float, float], size: tuple[float, float] = (48 * INCH, 30 * INCH), slide: float = 2 * INCH) -> float | None:
    """Offset along a piece's front face where a clear floor of this size fits before it, nearest the middle; else None."""
    cx, cy, hx, hy, angle = boxes[which]
    c, s = np.cos(angle), np.sin(angle)
    most = max(0.0, hx + size[0] / 2 - slide)
    steps = int(most / slide + 1e-9)
    offsets = sorted((k * slide for k in range(-steps, steps + 1)), key=lambda o: (abs(o), o))
    for o in offsets:
        u, v = o, -(hy + size[1] / 2 + 1e-3)
        patch = np.array([cx + u * c - v * s, cy + u * s + v * c, size[0] / 2, size[1] / 2, angle])
        if legal(np.vstack([boxes, patch]), len(boxes), room):
            return float(round(o, 6))
    return None


def widest_circle(boxes: np.ndarray, near: tuple[float, float], room: tuple[float, float], reach: float, step: float = 0.1) -> float:
    """Diameter of the widest clear circle with its centre on a grid within reach of a place."""
    corners = [K.corners(*b) for b in boxes]
    reaches = np.hypot(boxes[:, 2], boxes[:, 3])
    best = 0.0
    for x in np.arange(max(0, near[0] - reach), min(room[0], near[0] + reach) + 1e-9, step):
        for y in np.arange(max(0, near[1] - reach), min(room[1], near[1] + reach) + 1e-9, step):
            dot = np.array([[x, y], [x + 1e-9, y], [x, y + 1e-9]])
            clear = min(x, y, room[0] - x, room[1] - y)
            # No box is nearer than its centre less its half diagonal, so the rest can't matter once that is too far.
            least = np.hypot(boxes[:, 0] - x, boxes[:, 1] - y) - reaches
            for i in np.argsort(least):
                if least[i] >= clear or 2 * clear <= best:
                    break
                clear = min(clear, K.polygon_gap(dot, corners[i]))
            best = max(best, 2 * clear)
    return float(best)

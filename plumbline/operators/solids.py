"""Numeric kernels of solids, meshes and cameras; run per scan through `kernels.per_room`."""

from __future__ import annotations

import numpy as np


def box_distance(a: tuple, b: tuple) -> float:
    """Largest separation of two boxes (centre, half sizes, 3 x 3 axes in rows) along 15 axes; 0 when they touch.

    Exact where faces are nearest; a lower bound where edges or corners are.
    """
    (ca, ha, ra), (cb, hb, rb) = a, b
    axes = [*ra, *rb, *[np.cross(x, y) for x in ra for y in rb]]
    best = 0.0
    for axis in axes:
        size = np.linalg.norm(axis)
        if size > 1e-9:
            u = axis / size
            best = max(best, abs(u @ (cb - ca)) - (np.abs(ra @ u) @ ha) - (np.abs(rb @ u) @ hb))
    return float(best)


def voxel_components(cells: np.ndarray) -> np.ndarray:
    """Component of each integer cell over 26 neighbours, numbered by first cell."""
    at = {tuple(c): i for i, c in enumerate(cells.tolist())}
    label, n = np.full(len(cells), -1), 0
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    for i in range(len(cells)):
        if label[i] >= 0:
            continue
        label[i], stack = n, [i]
        while stack:
            c = cells[stack.pop()]
            for d in around:
                j = at.get((c[0] + d[0], c[1] + d[1], c[2] + d[2]))
                if j is not None and label[j] < 0:
                    label[j] = n
                    stack.append(j)
        n += 1
    return label


def fit_box(points: np.ndarray, least: float = 0.05, most: float = 6.0) -> tuple | None:
    """(centre, sizes, yaw) of the smallest upright box over the points; None for a sliver or something too large."""
    from plumbline.operators.kernels import hull

    ring = hull(points[:, :2])
    if len(ring) < 3:
        return None
    best = None
    for edge in np.roll(ring, -1, axis=0) - ring:
        yaw = float(np.arctan2(edge[1], edge[0]))
        c, s = np.cos(yaw), np.sin(yaw)
        local = ring @ np.array([[c, -s], [s, c]])
        low, high = local.min(0), local.max(0)
        if best is None or np.prod(high - low) < best[0] - 1e-12:
            best = (np.prod(high - low), (low + high) / 2 @ np.array([[c, s], [-s, c]]), high - low, yaw)
    _, centre, size, yaw = best
    z = points[:, 2].min(), points[:, 2].max()
    sizes = np.array([*size, z[1] - z[0]])
    if sizes.max() > most or np.sort(sizes)[1] < least:
        return None
    return np.array([*centre, sum(z) / 2]), np.maximum(sizes, least), yaw


def register(source: np.ndarray, target: np.ndarray, tolerance: float) -> tuple[float, np.ndarray] | None:
    """Yaw and translation in the plane that bring source onto target by least squares; None for fewer than three
    pairs or a residual over four tolerances."""
    if len(source) < 3:
        return None
    a, b = source - source.mean(0), target - target.mean(0)
    yaw = float(np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum()))
    turn = np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
    shift = target.mean(0) - turn @ source.mean(0)
    worst = np.linalg.norm(source @ turn.T + shift - target, axis=1).max()
    return None if worst > 4 * tolerance else (yaw, shift)


def project(points: np.ndarray, pose: np.ndarray, intrinsics: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Pixel and depth of world points in a camera that looks along -z of its pose; NaN outside the frame."""
    local = (points - pose[:3, 3]) @ pose[:3, :3]
    depth = -local[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = intrinsics[0, 0] * local[:, 0] / depth + intrinsics[0, 2]
        v = -intrinsics[1, 1] * local[:, 1] / depth + intrinsics[1, 2]
    seen = (depth > 0) & (u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1])
    return np.where(seen[:, None], np.stack([u, v, depth], 1), np.nan)


def visible(pixels: np.ndarray, size: tuple[int, int], slack: float = 0.08) -> np.ndarray:
    """Which projected points no nearer point hides: depth within `slack` of the pixel's nearest."""
    inside = ~np.isnan(pixels[:, 2])
    flat = np.where(inside, np.nan_to_num(pixels[:, 1]).astype(int) * size[0] + np.nan_to_num(pixels[:, 0]).astype(int), 0)
    nearest = np.full(size[0] * size[1], np.inf)
    np.minimum.at(nearest, flat[inside], pixels[inside, 2])
    return inside & (pixels[:, 2] <= nearest[flat] + slack)


def steepest(vertices: np.ndarray, triangles: np.ndarray, band: tuple[float, float] = (-0.0254, 1.2), most: float = 45.0) -> float | None:
    """Largest slope in degrees among floor triangles: those within a height band and no steeper than `most`."""
    a, b, c = (vertices[triangles[:, i]] for i in range(3))
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    slope = np.degrees(np.arccos(np.clip(np.abs(n[:, 2]) / np.maximum(size, 1e-12), 0, 1)))
    z = (a + b + c)[:, 2] / 3
    floor = (size > 1e-12) & (z >= band[0]) & (z <= band[1]) & (slope <= most)
    return float(slope[floor].max()) if floor.any() else None


def planes(centres: np.ndarray, normals: np.ndarray, areas: np.ndarray, angle: float = 10.0, offset: float = 0.05) -> list[tuple[float, list[int]]]:
    """Coplanar groups of faces, largest area first: the largest free face seeds, and faces near its plane join it."""
    left, out = np.ones(len(areas), bool), []
    while left.any():
        seed = int(np.argmax(np.where(left, areas, -1)))
        along = np.abs(normals @ normals[seed]) >= np.cos(np.radians(angle))
        member = left & along & (np.abs((centres - centres[seed]) @ normals[seed]) <= offset)
        out.append((float(areas[member].sum()), np.flatnonzero(member).tolist()))
        left &= ~member
    return sorted(out, key=lambda g: (-g[0], g[1]))


def image_scores(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> dict[str, float | None]:
    """Masked mean squared error, its PSNR (100 at most), and the share of the mask with no signal in b."""
    if not mask.any():
        return {"mse": None, "psnr": None, "uncovered": None}
    mse = float(((a - b)[mask] ** 2).mean())
    return {"mse": mse, "psnr": min(100.0, -10 * np.log10(mse)) if mse > 0 else 100.0, "uncovered": float((b[mask] == 0).mean())}


def packed_bits(grid: np.ndarray) -> str:
    """A boolean grid as zlib-compressed bits in base64."""
    import base64
    import zlib

    return base64.b64encode(zlib.compress(np.packbits(grid.ravel()).tobytes())).decode()


def unpacked_bits(text: str, shape: tuple[int, int]) -> np.ndarray:
    import base64
    import zlib

    bits = np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(text)), np.uint8))
    return bits[: shape[0] * shape[1]].reshape(shape).astype(bool)

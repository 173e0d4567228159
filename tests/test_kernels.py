import itertools

import numpy as np
import pytest

from plumbline.operators import kernels as K


@pytest.mark.parametrize("seed", range(12))
def test_clearance_and_widest_path_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    free = rng.random((rng.integers(6, 14), rng.integers(6, 14))) > 0.25
    free[0, 0] = free[-1, -1] = True
    room = K.clearance(free, 1.0)
    padded = np.pad(free, 1)
    blocked = np.argwhere(~padded)
    for r, c in np.argwhere(free):
        assert room[r, c] == pytest.approx(np.linalg.norm(blocked - [r + 1, c + 1], axis=1).min())
    width, path = K.widest_path(room, (0, 0), (free.shape[0] - 1, free.shape[1] - 1))
    # The widest path is as wide as the largest threshold that keeps both ends connected.
    ok = [w for w in np.unique(room[free]) if (lab := K.labels(room >= w))[0, 0] and lab[0, 0] == lab[-1, -1]]
    assert width == (max(ok) if ok else 0.0)
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in itertools.pairwise(path))


@pytest.mark.parametrize("seed", range(20))
def test_polygons(seed):
    rng = np.random.default_rng(seed)
    a, b = (K.corners(*rng.uniform(-3, 3, 2), *rng.uniform(0.05, 1, 2), rng.uniform(0, 6.3)) for _ in range(2))
    gap, both = K.polygon_gap(a, b), K.clip(a, b)
    assert (gap == 0) == (len(both) > 0)
    assert gap == pytest.approx(K.polygon_gap(b, a))
    assert K.area(K.hull(np.concatenate([a, a.mean(0, keepdims=True)]))) == pytest.approx(K.area(a))
    if len(both) > 2:
        assert K.area(both) <= min(K.area(a), K.area(b)) + 1e-9


def test_raster_square_ray_and_isovist():
    owner = K.rasterise(2.0, 1.0, np.array([[1.0, 0.5, 0.25, 0.5, 0.0]]), 0.05)
    assert (owner >= 0).sum() == 10 * 20
    assert K.largest_square(owner < 0, 0.05) == pytest.approx(0.75)
    assert K.labels(owner < 0).max() == 2
    assert K.ray_box(np.zeros(3), np.array([1.0, 0, 0]), np.array([2.0, -1, -1]), np.array([3.0, 1, 1])) == 2.0
    assert K.ray_box(np.zeros(3), np.array([-1.0, 0, 0]), np.array([2.0, -1, -1]), np.array([3.0, 1, 1])) is None
    square = np.array([[-1, -1, 1, -1], [1, -1, 1, 1], [1, 1, -1, 1], [-1, 1, -1, -1]], float)
    assert K.isovist(np.zeros(2), square) == pytest.approx(4.0, rel=0.01)

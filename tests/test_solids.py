import numpy as np
import pytest

from plumbline.operators import solids as S


def box(x, yaw=0.0):
    c, s = np.cos(yaw), np.sin(yaw)
    return np.array([x, 0.0, 0.0]), np.array([0.5, 0.5, 0.5]), np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])


def test_box_distance():
    assert S.box_distance(box(0), box(3)) == pytest.approx(2.0)
    assert S.box_distance(box(0), box(0.9)) == 0.0
    assert S.box_distance(box(0), box(3, np.pi / 4)) == pytest.approx(3 - 0.5 - np.sqrt(0.5))


def test_fit_box_and_registration():
    rng = np.random.default_rng(0)
    p = rng.uniform(-0.5, 0.5, (400, 3)) * [2.0, 1.0, 0.4]
    p = np.concatenate([p, np.array([[a, b, 0] for a in (-1, 1) for b in (-0.5, 0.5)])])
    yaw = 0.3
    turn = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
    centre, sizes, _ = S.fit_box(p @ turn.T + [1, 2, 3])
    assert sorted(sizes[:2]) == pytest.approx([1.0, 2.0]) and centre[:2] == pytest.approx([1, 2])
    assert S.fit_box(p * 10) is None
    found, shift = S.register(p[:, :2], p[:, :2] @ turn[:2, :2].T + [5, -1], 0.01)
    assert found == pytest.approx(yaw) and shift == pytest.approx([5, -1])
    assert S.register(p[:2, :2], p[:2, :2], 0.01) is None
    assert S.register(p[:50, :2], rng.permutation(p[:50, :2]), 0.01) is None


def test_voxels_planes_slopes_and_bits():
    cells = np.array([[0, 0, 0], [1, 1, 1], [5, 5, 5], [2, 2, 2]])
    assert S.voxel_components(cells).tolist() == [0, 0, 1, 0]
    centres = np.array([[0.0, 0, 0], [1, 0, 0], [0, 0, 1]])
    normals = np.array([[0.0, 0, 1], [0, 0, 1], [0, 0, 1]])
    assert S.planes(centres, normals, np.array([1.0, 2.0, 0.5])) == [(3.0, [0, 1]), (0.5, [2])]
    v = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0.1]])
    assert S.steepest(v, np.array([[0, 1, 2], [0, 3, 2]])) == pytest.approx(np.degrees(np.arctan(0.1)))
    assert S.steepest(v + [0, 0, 9], np.array([[0, 1, 2]])) is None
    grid = np.random.default_rng(1).random((7, 9)) > 0.5
    assert (S.unpacked_bits(S.packed_bits(grid), grid.shape) == grid).all()


def test_projection_and_occlusion():
    k = np.array([[100.0, 0, 50], [0, 100, 50], [0, 0, 1]])
    p = np.array([[0.0, 0, -1], [0, 0, -2], [0, 0, 1], [9, 0, -1], [0.3, 0, -2]])
    pixels = S.project(p, np.eye(4), k, (100, 100))
    assert pixels[0].tolist() == [50, 50, 1] and np.isnan(pixels[2:4]).all()
    assert S.visible(pixels, (100, 100)).tolist() == [True, False, False, False, True]
    a, b = np.full((4, 4), 0.5), np.full((4, 4), 0.4)
    scores = S.image_scores(a, b, np.ones((4, 4), bool))
    assert scores["mse"] == pytest.approx(0.01) and scores["psnr"] == pytest.approx(20) and scores["uncovered"] == 0

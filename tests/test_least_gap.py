import numpy as np

from plumbline.operators import kernels as K


def test_least_gap_measures_few_pairs_and_finds_the_least(monkeypatch):
    r = np.random.default_rng(4)
    shapes = [K.corners(3.0 * (i % 20) + r.uniform(0, 0.8), 3.0 * (i // 20) + r.uniform(0, 0.8), 0.6, 0.5, r.uniform(0, 3)) for i in range(200)]
    want = min(K.polygon_gap(a, b) for i, a in enumerate(shapes) for b in shapes[:i])
    seen, real = [], K.polygon_gap
    monkeypatch.setattr(K, "polygon_gap", lambda a, b: seen.append(1) or real(a, b))
    assert K.least_gap(shapes) == want > 0 and len(seen) < 1000
    assert K.least_gap([*shapes, shapes[7]]) == 0 and K.least_gap(shapes[:1]) is None

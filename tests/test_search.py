import numpy as np
import pandas as pd
import pytest

from plumbline.functions.exprs import INCH
from plumbline.plans import search

ROOM = (4.0, 3.0)


def test_widen_moves_a_movable_piece_at_the_pinch():
    # Two pieces leave a narrow gap across the room; the second may move.
    rows = pd.DataFrame({"piece": [1, 2], "cx": [2.0, 2.0], "cy": [0.6, 2.3], "half_x": [0.3, 0.3], "half_y": [0.6, 0.5], "angle": [0.0, 0.0], "movable": [False, True]})
    stops = [(0.2, 1.5), (3.8, 1.5)]
    got = search.widen(rows, ROOM, 0.05, stops, limit=100)
    assert got["piece"] == 2 and got["after"] >= got["before"] + 1
    fixed = search.widen(rows.assign(movable=False), ROOM, 0.05, stops)
    assert fixed["piece"] is None and fixed["after"] == fixed["before"] == got["before"]


def test_places_and_approaches():
    boxes = np.array([[0.5, 0.3, 0.5, 0.3, 0.0], [2.0, 2.0, 0.4, 0.3, 0.0]])
    x, y = search.place_along_walls(boxes, (1.0, 0.6), ROOM)
    assert search.legal(np.vstack([boxes, [x, y, 0.5, 0.3, 0.0]]), 2, ROOM) and (x, y) == (1.75, 0.3)
    assert search.place_along_walls(boxes, (5.0, 0.6), ROOM) is None
    assert search.approach(boxes, 1, ROOM) == 0.0
    assert search.approach(boxes, 0, ROOM) is None  # its front faces the wall
    assert search.widest_circle(np.empty((0, 5)), (2.0, 1.5), ROOM, 0.5) == pytest.approx(3.0)
    assert search.route_width(np.empty((0, 5)), ROOM, 0.05, [(0.2, 1.5), (3.8, 1.5)]) > 36 * INCH


def test_free_places_turn_clear_of_every_piece(spark, monkeypatch):
    from plumbline.operators import kernels as K
    from plumbline.operators import queries_spatial as Q

    rooms = Q._rooms(spark, "/root/testdata/sf0.01").filter("room between 4 and 6")
    monkeypatch.setattr(Q, "_rooms", lambda spark, sf_dir: rooms)
    got = {r.room: r.turn for r in Q.free_places(spark, "").collect()}
    want = {}
    for room, rows in rooms.toPandas().groupby("room"):
        boxes, width, depth = Q._boxes(rows), *Q.ROOM[:2]
        assert len(boxes) > 12
        x0, y0 = boxes[0, :2]
        want[room] = max(
            2 * min([x, y, width - x, depth - y, *[K.polygon_gap(np.array([[x, y], [x + 1e-9, y], [x, y + 1e-9]]), K.corners(*b)) for b in boxes]])
            for x in np.arange(max(0, x0 - 1), min(width, x0 + 1) + 1e-9, 0.25)
            for y in np.arange(max(0, y0 - 1), min(depth, y0 + 1) + 1e-9, 0.25)
        )
    assert got == pytest.approx({k: max(0.0, v) for k, v in want.items()}, abs=2e-6)

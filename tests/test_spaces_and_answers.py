"""Clear spaces, constraints of layouts and judged answers on hand-made scenes."""

from plumbline.plans import spaces, verified

BOX = "scene long, id long, x double, y double, width double, depth double"


def test_doors_and_kiosks(spark):
    doors = spark.createDataFrame([(1, 1, 50.0, 0.0, 32.0, 4.0), (2, 2, 50.0, 0.0, 32.0, 4.0), (3, 3, 50.0, 0.0, 32.0, 4.0), (4, 4, 50.0, 0.0, 32.0, 4.0)], BOX)
    # Just far enough to pull, to push alone, too near, and one beside the opening.
    things = spark.createDataFrame([(1, 11, 50.0, 67.0, 10.0, 10.0), (2, 12, 80.0, 60.0, 12.0, 10.0), (3, 13, 50.0, 20.0, 10.0, 10.0), (4, 14, 80.0, 20.0, 10.0, 10.0)], BOX)
    got = {r.id: (r.outcome, r.depth) for r in spaces.door_clearances(doors, things).collect()}
    assert got == {1: ("passes", 60.0), 2: ("question", 53.0), 3: ("problem", 13.0), 4: ("passes", None)}
    assert spaces.door_clearances(doors.limit(0), things).count() == 0

    kiosks = spark.createDataFrame([(1, 1, 100.0, 100.0, 20.0, 20.0), (2, 2, 100.0, 10.0, 20.0, 20.0), (3, 3, 40.0, 40.0, 20.0, 20.0)], BOX)
    walls = [(3, 31 + i, x, y, w, d) for i, (x, y, w, d) in enumerate([(40.0, 26.0, 200.0, 4.0), (40.0, 54.0, 200.0, 4.0), (26.0, 40.0, 4.0, 24.0), (54.0, 40.0, 4.0, 24.0)])]
    near = spark.createDataFrame([(1, 11, 100.0, 80.0, 4.0, 4.0), *walls], BOX)
    got = {r.id: (r.outcome, r.face) for r in spaces.clear_floors(kiosks, near, (200.0, 200.0)).collect()}
    # Its front is taken; three sides of it are outside the room; it is walled in.
    assert got == {1: ("passes", 1), 2: ("passes", 2), 3: ("problem", 0)}


def test_constraints_of_a_changed_layout(spark):
    before = spark.createDataFrame(
        [(1, 1, 1.0, 1.0, 0.5, 0.5, True), (1, 2, 3.0, 3.0, 0.5, 0.5, False), (1, 3, 5.0, 5.0, 0.5, 0.5, True), (1, 4, 2.0, 7.0, 0.5, 0.5, True), (1, 5, 5.0, 7.0, 0.5, 0.5, True), (1, 6, 5.5, 1.0, 0.5, 0.5, True), (1, 7, 5.0, 3.0, 0.5, 0.5, True)],
        BOX + ", movable boolean",
    )
    after = spark.createDataFrame(
        [(1, 1, 3.2, 3.0, 0.5, 0.5), (1, 2, 3.1, 3.0, 0.5, 0.5), (1, 3, 5.0, 4.9, 0.6, 0.5), (1, 5, 5.0, 7.9, 0.5, 0.5), (1, 6, 3.0, 0.5, 0.5, 0.5), (1, 7, 5.0, 4.4, 0.5, 0.5), (1, 8, 0.8, 4.8, 0.5, 0.5)], BOX
    )
    zones = spark.createDataFrame([(1, 3.0, 0.5, 1.0, 1.0)], "scene long, x double, y double, width double, depth double")
    seen = spark.createDataFrame([(1, i, j) for i in range(12) for j in range(16) if (i, j) != (1, 9)], "scene long, i int, j int")
    got = {(r.id, r.violation) for r in spaces.layout_violations(before, after, zones, seen, (6.0, 8.0), 1.5, 0.5, 0.5).collect()}
    # Piece 8 is new and covers the middle of the one unseen cell; piece 7 now stands in front of piece 3.
    assert got == {
        (1, "too_far"), (1, "collision"), (2, "locked_move"), (2, "collision"), (3, "resized"), (3, "lost_room"), (4, "removed"), (5, "off_floor"), (6, "keep_clear"), (6, "too_far"), (8, "unseen_floor"),
    }
    assert spaces.layout_violations(before, before.drop("movable"), zones, seen, (6.0, 8.0), 1.5, 0.5, 0.5).count() == 0


def test_answers_are_judged(spark):
    answers = [
        (1, 1, "The sofa is 2.0 metres wide.", "how wide is it"), (2, 1, "There is no lamp.", "is there a lamp"), (3, 1, "No sofa stands by the lamp.", None), (4, 1, "The sofa is 79 inches wide.", "how wide"),
        (5, 1, "It is 5.5 wide.", "is it five or 5.5 feet"), (6, 1, "It is 913 wide.", None), (7, 2, "The sofa is here.", None), (8, 3, "The sofa is here.", None), (9, 1, None, None), (10, 1, "a zero lamp", None), (11, 1, "0.25 and 0", None),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    judged = verified.verdicts(
        frame(answers, "id long, scene long, text string, asked string"), frame([("sofa",), ("lamp",)], "kind string"), frame([(1, "sofa"), (1, "sofa"), (2, "sofa")], "scene long, kind string"),
        frame([(1, 2.0), (1, 0.0), (1, None)], "scene long, value double"), frame([(1, 0.9), (2, 0.3)], "scene long, share double"), 0.6,
    )
    got = {r.id: r.refused for r in judged.collect()}
    assert got[1] is None and got[9] is None and got[5] is None
    assert got[2] == got[10] == "absence as zero" and got[3] == "not in the scan" and got[4] == got[6] == got[11] == "figures from nowhere"
    assert got[7] == got[8] == "not measured enough"

"""Scenes, packs, answers, ordered operators and aggregates against files, plain loops and brute force."""

import json
import random
from math import hypot

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.functions import text as T
from plumbline.operators import evaluation, layouts, rel, scene, seq, spatial
from plumbline.plans import answers, packs
from plumbline.sources import io
from plumbline.streaming import jobs
from tests.conftest import SMALL


def test_rule_packs_and_ledgers_from_files(spark, tmp_path):
    rule = {"id": "a", "citation": {"section": "1"}, "threshold": 36.0}
    pack = {"version": "1", "rules": [rule, {**rule, "id": "b", "unit": "mm", "comparison": "at_most", "measure": "top_m"}, {**rule, "id": "c", "tier": 2}]}
    (tmp_path / "pack.json").write_text(json.dumps(pack, indent=1))
    rules = packs.read_pack(spark, str(tmp_path / "pack.json"))
    assert {r.id: (r.unit, r.comparison, r.measure, r.words) for r in rules.collect()} == {"a": ("in", "at_least", "width_m", "a"), "b": ("mm", "at_most", "top_m", "b"), "c": ("in", "at_least", "width_m", "c")}
    none = packs.read_ledger(spark, str(tmp_path / "missing.json"))
    assert {r.verified for r in packs.with_verification(rules, none).collect()} == {False}
    entry = {"rule_id": "a", "section": "1", "threshold": 36.0, "unit": "in", "verified_by": "p"}
    (tmp_path / "ledger.json").write_text(json.dumps({"entries": [entry, {**entry, "rule_id": "b"}]}))
    ledger = packs.read_ledger(spark, str(tmp_path / "ledger.json"))
    # b is verified in another unit; c is beyond the tier.
    assert {r.id: r.verified for r in packs.with_verification(rules, ledger).collect()} == {"a": True, "b": False}
    pack["rules"][0]["threshold"] = 32.0
    changed = packs.parse_pack(spark.createDataFrame([(json.dumps(pack),)], "doc string"))
    assert not any(r.verified for r in packs.with_verification(changed, ledger).collect())
    for bad, says in (([rule, rule], "share the id"), ([{**rule, "comparison": "near"}], "comparison"), ([{**rule, "measure": "x_m"}], "measure"), ([{"threshold": 1.0}], "without an id")):
        with pytest.raises(Exception, match=says):
            packs.parse_pack(spark.createDataFrame([(json.dumps({"version": "1", "rules": bad}),)], "doc string")).collect()


def test_rooms_meshes_and_poses_from_files(spark, tmp_path):
    room = {"walls": [{"category": {"wall": {}}, "dimensions": [4, 2.5, 0.1], "transform": [[1, 0, 0, 0]] * 4}], "objects": [{"category": "chair", "confidence": {"high": {}}, "dimensions": {"x": 1, "y": 2, "z": 3}}]}
    (tmp_path / "rooms").mkdir()
    (tmp_path / "rooms/a.json").write_text(json.dumps(room))
    found = {r.kind: r for r in io.read_rooms(spark, str(tmp_path / "rooms")).collect()}
    assert found["wall"].category == "wall" and found["wall"].confidence == "low" and len(found["wall"].matrix) == 16
    assert found["object"].confidence == "high" and (found["object"].x, found["object"].z) == (1, 3) and len(found["object"].id) == 64
    poses = [{"frame_id": f"f{i}", "timestamp": 9.0 - i, "transform": [0.0] * (16 if i != 2 else 9), "version": 1 if i != 3 else 7} for i in range(5)]
    (tmp_path / "poses.json").write_text(json.dumps(poses))
    wanted = spark.createDataFrame([("f0",), ("f2",), ("f3",), ("f4",)], "frame_id string")
    assert [r.frame_id for r in io.read_poses(spark, str(tmp_path / "poses.json"), wanted).collect()] == ["f4", "f0"]
    docs = spark.createDataFrame([("a", "no json"), ("b", json.dumps({"parts": []})), ("c", json.dumps({"parts": [{"transform": [0.0] * 16, "vertices": [0.0] * 9, "triangles": [0, 1, 2]}]}))], "path string, doc string")
    assert {r.path: (r.vertices, r.refused) for r in io.judged_meshes(docs, 10, 1000).collect()} == {"a": (0, "no parts"), "b": (0, "no parts"), "c": (3, None)}
    assert {r.refused for r in io.judged_meshes(docs, 2, 1000).filter("path = 'c'").collect()} == {"too many vertices"}


def test_trees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (12, 13)], "parent long, child long")
    up = {}
    for r in rel.ancestors(edges).collect():
        up.setdefault(r.node, {})[r.depth] = r.ancestor
    assert up[4] == {1: 3, 2: 2, 3: 1} and up[13] == {1: 12, 2: 11, 3: 10}
    parents = edges.select("child", "parent").union(spark.createDataFrame([(1, None)], "child long, parent long"))
    assert {r.node for r in rel.cyclic(parents).collect()} == {10, 11, 12, 13}
    assert rel.cyclic(parents.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(10)], "parent long, child long")
    with pytest.raises(RuntimeError, match="deeper"):
        rel.descendants(chain, spark.createDataFrame([(0,)], "root long"), max_depth=5)
    assert rel.descendants(chain, spark.createDataFrame([(0,)], "root long"), max_depth=10).count() == 11


def test_percentiles_and_covers(spark):
    r = random.Random(4)
    rows = [(g, round(r.gauss(0, 10), r.randrange(3))) for g in "aab" for _ in range(500)] + [("c", 2.0), ("d", None), ("a", None)]
    got = {x.g: x.q for x in seq.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0, 0.02, 0.5, 0.98, 1], accuracy=20).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], [0, 0.02, 0.5, 0.98, 1]).tolist())
    assert set(got) == {"a", "b", "c"}
    spans = [(i, float(a := r.randrange(200)), float(a + r.randrange(30))) for i in range(300)]
    found = {x.k: (x.n, x.overlap) for x in seq.covering(spark.createDataFrame(spans, "k long, low double, high double"), "k", "low", "high", 25.0).collect()}
    for i, a, b in spans:
        met = [min(b, d) - max(a, c) for j, c, d in spans if j != i and min(b, d) >= max(a, c)]
        assert found[i] == (len(met), pytest.approx(sum(met)))


def test_closest_pairs_however_far(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 1000.0, 0.0), (3, "a", 1000.0, 900.0), (4, "b", 0.0, 0.0), (5, "b", 0.1, 0.0), (6, "c", 5.0, 5.0)], "k long, g string, x double, y double")
    got = {r.g: (r.k, r.other, r.distance) for r in spatial.closest_pairs(points, "k", ["x", "y"], "g", 0.5).collect()}
    assert got == {"a": (2, 3, 900.0), "b": (4, 5, pytest.approx(0.1))}


def test_operators_in_order_against_loops(spark):
    events = sorted((r.user_id, r.ts.timestamp(), r.event_id, r.value) for r in spark.read.parquet(f"{SMALL}/events.parquet").collect())
    kept, last = set(), {}
    for u, t, e, v in events:
        h = float(e * 7 % 360)
        if u in last:
            turn = abs(h - last[u][2]) % 360
            if t - last[u][0] < 1800 or (t - last[u][0] < 43200 and abs(v - last[u][1]) < 100 and min(turn, 360 - turn) < 8):
                continue
        last[u] = (t, v, h)
        kept.add((u, e))
    assert {(r.user_id, r.event_id) for r in queries.QUERIES["walk_frames"](spark, SMALL).collect()} == kept
    state, want = {}, {}
    for o in sorted(spark.read.parquet(f"{SMALL}/orders.parquet").collect(), key=lambda o: o.o_orderkey):
        n, size = state.get(o.o_custkey, (0, 0))
        want[o.o_orderkey] = n < 5 and size + int(o.o_totalprice) <= 600_000
        if want[o.o_orderkey]:
            state[o.o_custkey] = (n + 1, size + int(o.o_totalprice))
    assert {r.job: r.admitted for r in queries.QUERIES["reserved_bytes"](spark, SMALL).collect()} == want
    picked = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        f = (r.vec_id, r.embedding[0], r.embedding[1], r.vec_id * 37 % 360)
        apart = lambda a, b: a[0] - b[0] > 40 or hypot(a[1] - b[1], a[2] - b[2]) > 0.3 or min(abs(a[3] - b[3]) % 360, 360 - abs(a[3] - b[3]) % 360) > 90
        own = picked.setdefault(r.label, [])
        if len(own) < 6 and all(apart(f, p) for p in own):
            own.append(f)
    assert {(r.label, r.frame) for r in queries.QUERIES["picked_frames"](spark, SMALL).collect()} == {(k, f[0]) for k, some in picked.items() for f in some}


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 2, 10), (1, 3, 10), (None, 4, 10), (2, 5, 99)], "owner long, job long, bytes long")
    got = {r.job: (r.owner, r.admitted) for r in jobs.reserved(df, "owner", "job", "bytes", 2, 50).collect()}
    assert got == {1: (None, True), 2: (None, True), 4: (None, False), 3: (1, True), 5: (2, False)}


def test_answers_against_a_loop(spark):
    import re

    number = re.compile(r"\d+(?:\.\d+)?")
    asked = ["leave 20 cm and half a metre", "two three-quarter steps", None, "nothing", "at 36 inches, twenty-five wide"]
    said = ["0.2 m", "6 or 0.6096, 1.5", "7", "", "0.9144 and 500 and 5, 0.508"]

    def stated(text):
        words = (text or "").lower().replace("-", " ").split()
        have = [answers.WORDS.get(w) for w in words]
        return [float(x) for x in number.findall(text or "")] + [x for x in have if x is not None] + [a * b for a, b in zip(have, have[1:], strict=False) if a is not None and b is not None]

    def bad(a, q):
        return sorted({v for v in map(float, number.findall(a)) if not any(abs(v - n * s) <= max(abs(v) * 0.02, 1e-6) for n in stated(q) for s in answers.SCALES)})

    df = spark.createDataFrame(list(enumerate(zip(asked, said, strict=True))), "i long, t struct<q: string, a: string>")
    got = {r.i: sorted(r.bad) for r in df.select("i", answers.invented(F.col("t.a"), answers.stated(F.col("t.q"))).alias("bad")).collect()}
    assert got == {i: bad(a, q) for i, (q, a) in enumerate(zip(asked, said, strict=True))}
    assert got[0] == [] and got[2] == [7.0] and 500.0 in got[4]


def test_digests_votes_and_layouts(spark):
    rows = [("t", "p", i, "fits" if i % 3 else "blocked") for i in range(40)]
    frame = lambda some: spark.createDataFrame(some, "task string, profile string, id long, outcome string")
    one, two = (evaluation.campaign(frame(x), "task", "profile", ["fits", "blocked"]).first() for x in (rows, rows[::-1]))
    assert one == two and (one.fits, one.blocked) == (26, 14)
    assert evaluation.campaign(frame([*rows[:-1], ("t", "p", 39, "fits")]), "task", "profile", ["fits", "blocked"]).first().digest != one.digest
    votes = spark.createDataFrame([("k", "chair", ["chair"], 1.0), ("k", "red chair", ["chair", "red"], 2.0), ("k", "stool", ["stool"], 2.5)], "k string, name string, words array<string>, weight double")
    assert evaluation.soft_vote(votes, "k", T.agree).first()[1:] == ("red chair", 3.0, round(3 / 5.5, 4))
    boxes = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 1.0), (2, 0, 1.5, 1.0, 1.0, 1.0), (3, 1, 1.5, 1.0, 1.0, 1.0)], "id long, scene long, x double, y double, width double, depth double")
    assert [tuple(r) for r in layouts.collisions(boxes, 2.0, group="scene").collect()] == [(1, 2)] and layouts.collisions(boxes, 2.0).count() == 3
    parts = spark.createDataFrame([("m", 0, [0.0] * 9, [0, 1, 2]), ("m", 1, [0.0] * 12, [0, 2, 3]), ("n", 0, [0.0] * 9, [2, 1, 0])], "mesh string, part int, vertices array<double>, triangles array<int>")
    assert {(r.mesh, r.part): list(r.triangles) for r in scene.joined_meshes(parts, ["mesh"], ["part"]).collect()} == {("m", 0): [0, 1, 2], ("m", 1): [3, 5, 6], ("n", 0): [2, 1, 0]}


def test_followed_runs_over_two_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for kind in ("click", "purchase"):
        e.filter(F.col("event_type") == kind).write.parquet(str(tmp_path / kind))
    read = lambda kind: spark.readStream.schema(e.schema).parquet(str(tmp_path / kind))
    joined = jobs.followed(read("click"), read("purchase"), "user_id", "ts", "6 hours", watermark="60 days")
    q = joined.writeStream.format("memory").queryName("followed_pairs").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["first"], r["then"]) for r in spark.table("followed_pairs").collect()}
    want = {(r["first"], r["then"]) for r in queries.QUERIES["clicks_then_purchases"](spark, SMALL).collect()}
    assert got == want and want

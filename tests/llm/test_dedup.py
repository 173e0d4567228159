import hashlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import decontamination, embedding_dedup, line_dedup, minhash_dedup, substring_dedup
from tests.llm.conftest import documents, odd_rows, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lines_against_brute_force(spark, prose):
    line = lambda i: prose(1000 + i, 9).ljust(45, "x")
    texts = ["\n".join(line((d * 7 + j) % 23) if j % 2 else f"  {line((d + j) % 5).upper()} \t" for j in range(d % 80)) for d in range(120)]
    texts += ["short\nshort"] * 6 + ["é" * 40 + "\nx"] * 5 + ["É" * 40]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    holders = defaultdict(set)
    for d, t in enumerate(texts):
        for s in t.split("\n"):
            holders[key(s)].add(d)
    got = {r.doc_id: r for r in line_dedup.digest(documents(spark, texts)).collect()}
    for d, t in enumerate(texts):
        lines = t.split("\n")
        gone = [len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and max(holders[key(s)]) != d for s in lines]
        assert (got[d].n_lines, got[d].n_dropped) == (len(lines), sum(gone))
        assert got[d].kept_sha256 == sha("\n".join(s for s, g in zip(lines, gone, strict=True) if not g))


def test_lines_of_odd_rows(spark):
    docs = odd_rows(documents(spark, ["x" * 50] * 5))
    got = line_dedup.digest(docs).collect()
    assert len(got) == 11
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got if r.doc_id == 900 or r.doc_id == 902} == {900: (1, 0), 902: (2, 0)}
    stripped = line_dedup.strip_lines(docs)
    assert stripped.columns == docs.columns and stripped.count() == 11
    assert {r.doc_id: (r.text, r.n_chars) for r in stripped.collect() if r.doc_id in (0, 4, 900)} == {0: ("", 0), 4: ("x" * 50, 50), 900: (None, None)}
    assert line_dedup.digest(docs.limit(0)).count() == 0


def test_substrings_against_brute_force(spark, prose):
    base = [prose(i, 160, 5000) for i in range(30)]
    texts = list(base)
    for i in range(30):
        a, b = base[i].split(" "), base[(i + 1) % 30].split(" ")
        texts.append(" ".join(a[i : i + 49 + i % 4] + b[: 20 + i] + a[: 60 + i]))
    texts += ["ha " * (60 + 10 * i) for i in range(4)] + ["ha ho " * (30 + i) for i in range(4)] + [base[0], base[0]]
    texts += [" ".join(base[3].split(" ")[:50]), " ".join(base[3].split(" ")[:49])]
    split = [words(t, lower=False) for t in texts]
    first = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, texts)).collect()}
    for d, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        assert (got[d].n_words, got[d].n_removed) == (len(w), sum(gone)), d
        assert got[d].kept_sha256 == sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))


def test_substrings_of_odd_rows(spark, prose):
    got = substring_dedup.dedup_substrings(odd_rows(documents(spark, [prose(1, 80), prose(1, 80)]))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id in (0, 1)) == [(0, 0), (1, 80)]
    assert len(got) == 8 and all(r.n_words == 0 for r in got if r.doc_id in (900, 901, 902))


def near(sets, k):
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= k * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_duplicates_against_brute_force(spark, prose):
    import random

    r, texts = random.Random(5), []
    for family in range(6):
        base = prose(family, 120, 3000).split(" ")
        for _ in range(12 if family else 60):
            w = list(base)
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["one", "One", "two words", "two Words", "three little words", ""]
    sets = {d: shingles(t, 3) for d, t in enumerate(texts)}
    want = near(sets, 85)
    got = {x.doc_id: x for x in minhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert {d: x.component_id for d, x in got.items()} == want
    assert all(got[d].n_shingles == len(sets[d]) and got[d].kept == (want[d] == d) for d in want)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_dedup.near_duplicates(odd_rows(documents(spark, ["a b c d", "A b c d", "q"]))).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, None: None, 900: 900, 901: 901, 902: 902, 903: 903}
    assert all(r.kept for r in got if r.doc_id != 1) and len(got) == 9


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        both, alone = int(1000 * j), int(1000 * (1 - j) / 2)
        h = rng.integers(0, 2**63, both + 2 * alone, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(h[: both + alone]), np.unique(np.concatenate([h[:both], h[both + alone :]]))
        ra, rb = minhash_dedup.registers([a, b], minhash_dedup.WIDE)[:, None]
        assert minhash_dedup.likely_similarity(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(j, abs=0.07)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((260, 24))
    x[40:100] = x[0] + 0.12 * rng.standard_normal((60, 24))
    x[100:140] = x[1] + 0.2 * rng.standard_normal((40, 24))
    x[140] = 3 * x[2]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 24), (502, [float("nan")] + [1.0] * 23), (503, [1.0]), (504, []), (505, [None] * 24), (None, x[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(260)] == g.sum(1).tolist()
    assert got[140].component_id == 2 and not got[140].kept
    for i in (500, 501, 502, 503, 504, 505):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    # Tiles far smaller than the groups count the same.
    embedding_dedup.TILE = 16
    try:
        assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()} == {i: r.n_links for i, r in got.items()}
    finally:
        embedding_dedup.TILE = 1024


def test_contamination(spark, prose):
    item = prose(7, 30, 9000)
    partly = " ".join(item.split(" ")[:27])
    half = " ".join(item.split(" ")[:15])
    items = spark.createDataFrame([(1, item), (2, "Just Three Words"), (3, None), (4, ""), (5, prose(8, 200, 9000))], "item_id long, text string")
    docs = documents(spark, [prose(1, 500) + " " + item.upper() + " " + prose(2, 700), partly, half, "so just three words here", "just three  other words", prose(9, 4000)])
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contaminated(odd_rows(docs), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2)}
    assert got[0, 1] == 1.0 and got[1, 1] == pytest.approx(23 / 26)
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


def test_embedding_pairs_in_a_dense_group_below_the_threshold(spark):
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, dim = 3000, 64
    cone = unit(unit(r.standard_normal(dim)) + 0.42 * unit(r.standard_normal((n, dim))))
    away = r.standard_normal((60, dim))
    away = unit(away - (away * cone[:60]).sum(1, keepdims=True) * cone[:60])
    x = np.concatenate([cone, 0.952 * cone[:60] + np.sqrt(1 - 0.952**2) * away]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.95
    assert 60 <= (near.sum() - len(x)) // 2 < 200
    got = {v.vec_id: v for v in embedding_dedup.near_duplicates(vectors).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert all(got[n + i].component_id == got[i].component_id and not got[n + i].kept for i in range(60))

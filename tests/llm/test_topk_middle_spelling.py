"""Exact top-k, fill-in-middle and spelling variants against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from plumbline.llm import fill_in_middle, spelling, top_k
from tests.llm.conftest import LOWER, crc, documents, odd_rows

VECTORS = "vec_id long, embedding array<float>"


# Exact top-k


def best(rows, queries, k):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for q, v in queries:
        found = sorted(((-dot(v, w), i) for i, w in rows if i != q))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


def as_set(df):
    return {(r.query_id, r["rank"], r.id, r.score) for r in df.collect()}


@pytest.mark.parametrize("share", [0.0, 0.7])
def test_top_k_against_brute_force(spark, share):
    r = random.Random(5)
    # Sparse and dense, signed, with ties, copies and vectors of unequal length.
    make = lambda: [0 if r.random() < share else r.randrange(-9, 10) for _ in range(r.choice([8, 8, 8, 5]))]
    rows = [(i, make()) for i in range(300)] + [(1000 + i, [5] * 8) for i in range(40)] + [(2000, []), (2001, [0] * 8)]
    queries = [rows[i] for i in range(0, 300, 11)] + [(1000, [5] * 8), (2000, []), (9999, [-1] * 9)]
    frame = lambda x: spark.createDataFrame(x, "id long, vector array<long>")
    for shard, block, range_rows in ((10_000, 10_000, 16), (40, 7, 8)):
        got = top_k.top_k(frame(rows), frame(queries), 10, shard=shard, block=block, range_rows=range_rows)
        assert as_set(got) == best(rows, queries, 10)


def test_terms_are_left_out_once_enough_is_known():
    r = np.random.default_rng(2)
    vectors = [np.concatenate([r.integers(-100, 100, 4), r.integers(-3, 4, 20)]) for _ in range(400)]
    one = top_k._Range(np.arange(400), vectors)
    query = np.ones(24, np.int64)
    scores = np.array([v.sum() for v in vectors])
    beat = int(np.sort(scores)[-10])
    at, found = one.competitive(query, beat)
    assert sorted(at) == sorted(np.flatnonzero(scores > beat)) and (found == scores[at]).all()


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (100, [0.0009, 1.0]), (100, [0.0009, 1.0]), (1, [1.0, -0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (200, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "vector", "score", "rank", "shard", "label")})
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.nearest(df).collect()}
    ints = [(0, [1024, -512]), (100, [0, 1024]), (1, [1024, -512]), (200, [])]
    assert got == best(ints, [x for x in ints if x[0] % 100 == 0], 10)
    assert top_k.nearest(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(PythonException, match="fit a long"):
        top_k.nearest(huge).collect()


# Fill-in-middle


def middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def marked():
    r = random.Random(11)
    pieces = ["ab", "P", "S", "M", "<", ">", "<P", "<S>", "é", "\n", " ", "𝄞", "Z", "[", "`", "{", "@", "\x00"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 60))) for _ in range(150)]
    texts += ["".join(r.choice([p for p in pieces if p != "<S>"]) for _ in range(r.randrange(0, 90))) for _ in range(250)]
    return texts + ["", None, "a" * 500, "<P>", "x<M>y", "<", "<P", "P>", "é" * 100, texts[3], texts[3]]


@pytest.mark.parametrize("chunk,fan", [(1, 2), (7, 3), (64, 64), (32_768, 64)])
def test_middle_against_brute_force(spark, marked, chunk, fan):
    df = fill_in_middle.fill_in_middle(documents(spark, marked), chunk=chunk, fan=fan)
    got = df.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(marked)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle(r.doc_id, marked[r.doc_id])
        assert r.back == (marked[r.doc_id] or "")
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_functions_of_chunks_compose(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("<PSMa> é") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    rows = []
    for key, text in enumerate(texts):
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(3))
        for pos, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True)):
            rows.append((key, pos, *fill_in_middle.summary(fill_in_middle.points(text[i:j]))))
    functions = spark.createDataFrame(rows, f"key int, pos long, {fill_in_middle.FUNCTION}")
    runs = functions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "ends", "counts", "marks"))).alias("fs"))
    for x in runs.select("key", F.expr(fill_in_middle.COMPOSED).alias("f")).collect():
        text = texts[x.key]
        whole = fill_in_middle.summary(fill_in_middle.points(text))
        assert (x.f.ends, x.f.counts, x.f.marks) == whole
        assert whole[1][0] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
        assert whole[2][0] == any(m in text for m in ("<P>", "<S>", "<M>"))


def test_middle_of_odd_rows(spark):
    # Copies of a giant text, whose cuts differ by doc_id, and a giant text of one word.
    giant = "\n".join(f"word{i} é" for i in range(40_000))
    docs = odd_rows(documents(spark, [giant, giant, "q" * 300_000, "plain text"]))
    got = fill_in_middle.digest(docs).collect()
    texts = {0: giant, 1: giant, 2: "q" * 300_000, 3: "plain text", None: "a b c", 900: None, 901: "", 902: " \n\t", 903: "Ä Ö"}
    assert len(got) == 10
    for r in got:
        n, form, p, m, output = middle(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert fill_in_middle.digest(docs.limit(0)).count() == 0


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(n, ratio=5):
    words, out = list(n), {}
    nears = defaultdict(list)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                nears[a].append(b)
                nears[b].append(a)
    form = {w: min(nears[w], key=lambda x: (-n[x], x)) for w in words if nears[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(nears[w]), n[form[w]] if w in form else None)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_against_brute_force(spark):
    r = random.Random(8)
    letters = "abcdeéÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 10))) for _ in range(40)]
    words = Counter()
    for w in base:
        words[w] += r.choice([5, 40, 1000])
        for _ in range(12):
            i, c = r.randrange(len(w)), r.choice(letters)
            v = r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            words[v] = r.choice([5, 7, 25, 200])
    # A chain of forms, ties of the most frequent near word, and many words that share a half.
    words.update({"chainaaa": 5, "chainaab": 25, "chainabb": 125, "chainbbb": 625, "tietiez": 5, "tietiea": 50, "tietieb": 50})
    words.update({f"sharedhalf{a}{b}": 5 for a in "abcdefghij" for b in "abcdefghij"})
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_dict(spelling.variants(df))
    assert got == grouped(words)
    assert got["chainaaa"][:2] == ("chainaab", "chainbbb") and got["tietiez"][0] == "tietiea"


def test_words_of_documents_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["Garten", "Gärten", "gartens", "château", "chateau", "ÉCOLES", "écoles", "kurz", "abcdefg×", "aaaaaaa"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))) + r.choice(["", "-gartens1garten"]) for _ in range(900)]
    docs = odd_rows(documents(spark, texts))
    n = Counter()
    for row in docs.select("doc_id", "text").collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", row.text or ""):
            run = run.translate(LOWER)
            h = crc(f"{'' if row.doc_id is None else row.doc_id}:{run}")
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = Counter({w: c for w, c in n.items() if len(w) >= 6 and c >= 5})
    assert len(n) > len(vocabulary)  # some are misspelt often enough
    assert as_dict(spelling.group_variants(docs)) == grouped(n)
    assert spelling.group_variants(docs.limit(0)).count() == 0

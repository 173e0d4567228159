"""Odd input for every operator and stage: empty tables, repeated rows, clashing columns, null ids, very long texts, ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontamination, embedding_dedup, line_dedup, lm_scoring, minhash_dedup, packing, quality, substring_dedup, toxicity, url_filter
from tests.llm.conftest import SCHEMA, documents, odd_rows, words


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    plain = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(60)]
    long = "\n".join(" ".join(f"v{r.randrange(50_000)}" for _ in range(20)) for _ in range(7_000))
    assert len(long) > 900_000
    docs = odd_rows(documents(spark, [*plain, long, plain[0]]))
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(plain[5].split()[10:40])), (2, None)], "item_id long, text string")
    return docs, labels, items, long


OPERATORS = {
    "op1": lambda d, labels, items: quality.judge(d, labels),
    "op2": lambda d, labels, items: lm_scoring.score(d),
    "op3": lambda d, labels, items: line_dedup.digest(d),
    "op4": lambda d, labels, items: substring_dedup.dedup_substrings(d),
    "op6": lambda d, labels, items: toxicity.score(d, labels),
    "op10": lambda d, labels, items: minhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_odd_documents(tables, name):
    docs, labels, items, long = tables
    found = OPERATORS[name](docs, labels, items).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    rows = {}
    for r in found:
        rows.setdefault(r.doc_id, []).append(r.asDict())
    # Repeated rows have one result; the very long text is read to its end.
    assert rows[903][0] == rows[903][1]
    w = words(long)
    n = len(w)
    whole = {"op2": ("n_tokens", n + 1), "op3": ("n_lines", 7_000), "op4": ("n_words", n), "op1": ("n_words", n), "op10": ("n_shingles", len(set(zip(w, w[1:], w[2:], strict=False))))}
    if name in whole:
        column, want = whole[name]
        assert rows[60][0][column] == want
    empty = OPERATORS[name](docs.limit(0), labels, items)
    assert empty.count() == 0


def test_packing_of_odd_documents(tables):
    docs, _, _, long = tables
    rows = packing.pack_documents(docs).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces[903]) == 2 and len({(r.length, r.ids_crc32) for r in pieces[903]}) == 1
    assert len(pieces[None]) == 1 and pieces[901][0].length == 1 and pieces[900][0].length == 1
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.default_tokenizer()).encode(long, add_special_tokens=False).ids
    assert sum(r.length for r in pieces[60]) == len(ids) + 1 and all(r.length == 1024 for r in pieces[60] if r.piece)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_decontamination_of_odd_documents(tables):
    docs, _, items, _ = tables
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(5, 1)}


def test_vectors_repeated_and_with_clashing_columns(spark):
    x = np.random.default_rng(2).standard_normal((30, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 1, True) for i, v in enumerate([*x, x[0]])] + [(3, x[3].tolist(), 1, 1, True), (None, x[4].tolist(), 1, 1, True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id long, fp long, kept boolean")
    found = embedding_dedup.near_duplicates(df).collect()
    assert len(found) == 33 and {r.vec_id: r.component_id for r in found}[30] == 0
    assert [r.n_links for r in found if r.vec_id == 3] == [0, 0] and next(r for r in found if r.vec_id is None).kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    # Doubles are compared as they are: these two lie at 0.95 less 1e-9, which a float can't tell.
    c = 0.95 - 1e-9
    near = spark.createDataFrame([(0, [1.0, 0.0]), (1, [c, (1 - c * c) ** 0.5]), (2, [0.95 + 1e-9, (1 - (0.95 + 1e-9) ** 2) ** 0.5])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(near).collect()} == {0: 1, 1: 1, 2: 2}


def test_pages_repeated_null_and_with_clashing_columns(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "http://net/fr/", "h", "x", "x"), (1, "http://net/fr/", "h", "x", "x"), (None, "http://a.com/", None, None, None), (2, None, "h", "x", "x"), (3, "", "h", "x", "x"), (4, "http://b.example.com/en/" + "y" * 1_000_000, "h", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    found = url_filter.judge(pages, labels).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in found if r.page_id != 2 and r.page_id != 3) == [(0, "com/", "allow"), (1, "net/fr/", "block"), (1, "net/fr/", "block"), (4, "example.com/en/", "block")]
    assert {(r.page_id, r.host, r.path, r.rule) for r in found if r.page_id in (2, 3)} == {(2, "", "", None), (3, "", "", None)}
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    # Of two rules as long, the one that fits wins: hosts and paths of equal length never fit one url together.
    tie = spark.createDataFrame([(1, "http://net/es/"), (2, "http://net/fr/")], "page_id long, url string").withColumn("html", F.lit("h"))
    assert {r.page_id: r.rule for r in url_filter.judge(tie, labels).collect()} == {1: "net/es/", 2: "net/fr/"}


def test_head_keeps_or_leaves_equal_counts_together(spark):
    from plumbline.llm.common import frequent

    df = spark.createDataFrame([(i, 100 if i < 3 else 7) for i in range(20)], "code long, c long")
    assert sorted(r.code for r in frequent(df, "c", 10).collect()) == [0, 1, 2]
    assert frequent(df, "c", 20).count() == 20 and frequent(df, "c", 2).count() == 0


def test_pipeline_on_empty_and_odd_tables(tables, tmp_path):
    docs, labels, items, _ = tables
    spark = docs.sparkSession
    for name, some in (("odd", docs.drop("kept")), ("empty", docs.drop("kept").limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    whole = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        whole = stage(spark, whole, str(tmp_path / "odd"))
        assert {c.split()[0] for c in SCHEMA.split(", ")} <= set(whole.columns)
    ids = [r.doc_id for r in whole.select("doc_id").collect()]
    # A copy of a text under another id goes, so does the benchmark's text; rows that repeat a doc_id stay together.
    assert 61 not in ids and 5 not in ids and ids.count(903) == 2 and ids.count(None) == 1, ids

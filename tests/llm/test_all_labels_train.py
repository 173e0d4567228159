"""Models learn from all labelled documents, however many."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, lm_scoring, quality, toxicity


def test_quality_learns_from_all_trusted(spark):
    # 400 documents of 40,000 hold a symbol that no other has.
    own = F.udf(lambda i: "w" + chr(0x4E00 + i // 100))("doc_id")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(F.col("doc_id") % 100 == 0, own).otherwise("w"))
    p, _, _ = quality.trusted_model(docs, docs.select("doc_id"))
    hit, _ = p.look(quality.gram_keys([chr(0x4E00 + i) for i in range(400)]))
    assert hit.all()


def test_among_is_exact(spark):
    rows = spark.range(2000).select((F.col("id") % 1500 - 3).alias("doc_id"), F.col("id").alias("n")).union(spark.sql("select null, 1L"))
    ids = spark.range(5000).filter("id % 3 = 0").select(F.col("id").alias("doc_id"), F.lit("x").alias("cls"))
    got = sorted((r.doc_id, r.n, r.cls) for r in common.among(rows, ids).collect())
    assert got == sorted((n % 1500 - 3, n, "x") for n in range(2000) if n % 1500 >= 3 and n % 3 == 0)
    assert common.among(rows, ids.limit(0)).isEmpty()


def test_toxicity_learns_from_all_labelled(spark, monkeypatch):
    # Each text has a word of its own; copies count once, and a fifth fits the curve.
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.expr("concat(if(id % 2 = 0, 'bad ', 'good '), 'w', id div 4 * 2 + id % 2)").alias("text"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    seen = []
    levels = toxicity.levels
    monkeypatch.setattr(toxicity, "levels", lambda train: seen.append(train.groupBy("cls").count().collect()) or levels(train))
    got = toxicity.score(docs, labels, fold=(5, 5)).select("doc_id", "predicted").collect()
    ids = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(5)) != 0).select("text", (F.col("doc_id") % 2).alias("odd")).distinct().groupBy("odd").count().collect()
    assert {r.cls: r["count"] for r in seen[0]} == {"01"[r.odd == 0]: r["count"] for r in ids}
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)


def test_toxicity_counts_by_brute_force(spark, prose):
    train = [("01"[i % 2], prose(i, 40, 30)) for i in range(60)]
    got = toxicity.levels(spark.createDataFrame(train, "cls string, text string")).collect()
    two = Counter((c, p) for c, text in train for p in toxicity.pairs(text))
    every = {p: (two["1", p], two["0", p]) for _, p in two}
    often = {p: x for p, x in every.items() if sum(x) >= toxicity.LEAST_DOCS}
    assert {(r.ctx, r.sym): (r.t, r.o) for r in got if r.n == 2 and r.sym is not None} == often
    assert {(r.ctx, r.t, r.o): r.times for r in got if r.n == 2 and r.sym is None} == Counter((h, *x) for (h, w), x in every.items() if (h, w) not in often)
    words = {w: [(h, x) for (h, v), x in every.items() if v == w] for _, w in every}
    holds = Counter((c, w) for c, text in train for w in set(toxicity.tokens(text)))
    assert {r.sym: (r.ctx, r.t, r.o, r.both, r.dt, r.do) for r in got if r.n == 1} == {
        w: (w[: toxicity.STEM], sum(x[0] > 0 for _, x in b), sum(x[1] > 0 for _, x in b), len(b), holds["1", w], holds["0", w]) for w, b in words.items()
    }


def test_toxicity_moves_training_texts_once(spark, monkeypatch, prose):
    # What passes read is written: no pass shuffles texts again. Pairs travel without words, and few documents are objects at once.
    docs = spark.createDataFrame([(i, prose(i, 30, 30)) for i in range(300)] + [(7, prose(7, 30, 30)), (7, "else")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic").distinct()
    seen, levels = [], toxicity.levels
    monkeypatch.setattr(toxicity, "levels", lambda train: seen.append(train) or levels(train))
    toxicity.score(docs, labels)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and seen[0].count() > 150
    assert toxicity._pair_events(seen[0], 0).columns == ["ctx", "sym", "t", "o"]
    batch = pa.RecordBatch.from_pydict({"cls": ["0"] * 5000, "text": ["x"] * 5000})
    assert max(len(some) for _, some in toxicity._run_of([batch])) == toxicity.AT_ONCE < 2048


def test_lm_tokens_follow_context_within_classes(spark):
    # After a number comes always one word, after a mark another; both words have the class of their last letters.
    singles = " ".join(f"s{i}x s{i}x s{i}x" for i in range(20))
    rows = [(i, f"{singles} 12 xing {i % 7} xing ... aing !! aing ") for i in range(400)]
    docs = common.texts(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = common.cut(lm_scoring.token_counts(docs))
    model = lm_scoring.Model(*lm_scoring.trained(docs, counts)[0].value)
    some = ["x 12 xing", "x 12 aing", "x ... xing", "x ... aing", "unheard 12 newword"]
    found = [lm_scoring._tokens(t) for t in some]
    flat, starts = np.concatenate(found), np.cumsum([0, *[len(d) for d in found[:-1]]])
    classes, at = model.look(flat)
    if model.single[classes[starts + 2]].any():
        pytest.skip("words have classes of their own")
    p = (model.within(classes, at, starts) + np.log10(np.where(at >= 0, model.counts[at], 0) + 1))[starts + 2]
    assert p[0] > p[1] + 1 and p[3] > p[2] + 1
    # Tokens of a class, and what is unknown, sum to one after each class.
    every = model.totals(model.base[:, None] * np.exp(model.inner) / np.maximum(model.total, 1e-9)[model.own])
    assert every[model.total > 1e-6] == pytest.approx(1, abs=1e-4)


def test_lm_reads_training_texts_once_a_round(spark, monkeypatch, prose):
    texts = [prose(i, 20 + i % 9, 90) for i in range(120)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts, read, seen = common.cut(lm_scoring.token_counts(docs)), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    climbed = lm_scoring._climbed
    monkeypatch.setattr(lm_scoring, "_climbed", lambda model, n: seen.append((model, n)) or climbed(model, n))
    lm_scoring.trained(docs.mapInPandas(counted, docs.schema), counts)
    # The rounds count what follows what; no pass of its own does.
    assert read.value == lm_scoring.ROUNDS * len(texts)
    (model, n), want = seen[0], Counter()
    for t in texts:
        classes, at = model.look(lm_scoring._tokens(t))
        before = lm_scoring.CLASSES - 1
        for cls, place in zip(classes.tolist(), at.tolist(), strict=True):
            want[place if place >= 0 else len(model.head) + cls, before] += 1
            before = cls
    assert {(int(r), int(b)): int(n[r, b]) for r, b in zip(*np.nonzero(n), strict=True)} == want
    # Sums of many tasks' blocks, beyond what 32 bits hold.
    some = np.zeros(3 * lm_scoring.BLOCK * lm_scoring.CLASSES, np.int64)
    some[[0, 9000, 9001]] = 2**33, 300, 1
    blocks = lm_scoring._packed_counts(4, some)
    for block, rows in blocks.loc[blocks.index.repeat(3)].groupby("block"):
        at, c = lm_scoring._unpacked_counts(*lm_scoring._mean(rows)[["places", "w"]].iloc[0])
        assert (c == 3 * some[-1 - block + at]).all()
    assert len(blocks) == 2

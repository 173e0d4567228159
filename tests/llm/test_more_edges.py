"""Few labels, repeated items and ids, and extra columns with the operators' own names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontamination, minhash_dedup, packing, toxicity
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def plain():
    r = random.Random(12)
    return [" ".join(f"w{r.randrange(400)}" for _ in range(40)) for _ in range(60)]


def test_toxicity_without_entries_that_tell_classes_apart(spark, plain):
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.score(documents(spark, plain), labels).collect()
    share = {r.score for r in got}
    assert len(got) == 60 and len(share) == 1 and 0 < share.pop() < 0.4
    assert not any(r.predicted for r in got)


def test_repeated_benchmark_items(spark, plain):
    docs = documents(spark, plain)
    items = spark.createDataFrame([(1, " ".join(plain[3].split()[5:30])), (2, " ".join(plain[7].split()[:20])), (None, plain[9])], "item_id long, text string")
    once = sorted(map(repr, decontamination.contaminated(docs, items).distinct().collect()))
    again = sorted(map(repr, decontamination.contaminated(docs, items.union(items)).distinct().collect()))
    assert once == again and once


def test_packing_with_columns_of_its_own_names(spark, plain):
    docs = documents(spark, plain)
    extra = docs.withColumns({c: F.lit("x") for c in ("piece", "start", "length", "offset", "sequence_id", "ids_crc32", "pack_group")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(packing.pack_documents(docs).select(columns).collect()) == sorted(packing.pack_documents(extra).select(columns).collect())


def test_tiles_of_near_copies_with_repeated_ids(spark, plain, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "FEW", 2)
    words = plain[0].split() * 3
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 40, 2)] + plain[1:5]
    docs = documents(spark, texts)
    docs = docs.union(docs.filter("doc_id in (0, 1, 21)"))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()]
    assert len(got) == 27 and len(set(got)) == 24

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = [shingles(t) for t in texts]
    of = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    assert {(d, n, c) for d, n, c, _ in got} == {(i, len(s), of[i]) for i, s in enumerate(sets)}


def test_stages_with_a_column_named_kept(spark, plain):
    docs = documents(spark, [*plain, plain[0]]).withColumn("kept", F.lit("mine"))
    found = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.strip_lines(spark, docs, ""), "")
    assert found.columns == docs.columns and found.count() == 60 and {r.kept for r in found.select("kept").collect()} == {"mine"}

import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return SPLIT.findall((text or "").translate(LOWER) if lower else text or "")


def documents(spark, texts, first=0):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="session")
def prose():
    """Seeded texts of invented words: i-th text of n words."""
    import random

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.05 else "") for _ in range(n))

    return make


def odd_rows(docs):
    """`docs` with nulls in every column, an empty text, a repeated row, and columns with clashing names."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n\t", "en", "s", 3), (903, "Ä Ö", "de", "s", 3), (903, "Ä Ö", "de", "s", 3)], docs.schema)
    extra = {c: F.lit(1) for c in ("fp", "f1", "key", "kept", "pos", "col", "h1", "h2", "rep", "component_id", "bucket", "held_out", "score", "row", "id", "size", "mean", "code")}
    return docs.union(odd).withColumns(extra)

"""Spelling variants: words of a corpus, those one edit apart, and the most frequent form that each leads to.

A word's mask holds, for each letter, whether it occurs an odd number of times. One inserted or deleted code point
flips one bit of it, a replaced one two at the most, so of three bands of the mask at least one stays equal: words of
equal length, or one apart, meet where a band of theirs is equal, and are then verified. Many words share a band, so
its buckets are divided further by what one edit also leaves equal: the first half of the shorter word's length, or
else the last. Buckets are joined, verified and counted by the engine, pair by pair; a pair that meets in several
buckets counts in the first of them alone. Words are counted before anything is shuffled.

Defined results: a null text has no words; null doc_ids count as the text ''. Rows that repeat a doc_id count each.
Extra columns, whatever their names, are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, cut, texts

#: Letters of a word, and how often one is lost: fixed values of the contract.
LETTERS, LOST = r"A-Za-zÀ-ÿ", 199

#: Distinct words that a task holds before it sends their counts on.
HELD = 200_000

_lower = str.maketrans(UPPER, LOWER)


def misspelt(doc_id: str, run: str) -> str:
    """The lower-cased run as document `doc_id` has it: one code point is lost where the hash says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % LOST:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word and n, its occurrences, of words of at least `least_length` code points and `least_count` occurrences."""
    # Shorter runs can't give a word: none gets longer.
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own: Counter[str] = Counter()
                for run, n in Counter(runs.findall(text)).items():
                    own[run.lower() if run.isascii() else run.translate(_lower)] += n
                for run, n in own.items():
                    held[misspelt(doc_id, run)] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    named = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counts = named.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _bands(word: Column) -> Column:
    """Three numbers: parities of the letters, dealt to the bands in turn."""
    # a to z are 0 to 25, the letters from À on follow; any other code point shares a bit with one of them.
    place = lambda c: F.pmod(F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26), F.lit(90))
    letters = F.transform(F.split(word, ""), place)
    flip = lambda band: F.aggregate(
        F.filter(letters, lambda p: p % 3 == band), F.lit(0).cast("long"), lambda mask, p: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(p / 3).cast("int")))
    )
    return F.array(*[flip(band) for band in range(3)])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, other, other_n) of `words` (word, n; distinct) that differ by one code point, each pair once."""
    masked = cut(words.select("word", "n", F.length("word").alias("size"), _bands(F.col("word")).alias("bands")))
    # The length of the shorter word of a pair: one's own, or one less.
    sized = masked.withColumn("short", F.explode(F.array("size", F.col("size") - 1)))
    front = F.substring(F.col("word"), F.lit(1), F.floor(F.col("short") / 2).cast("int"))
    back = F.right(F.col("word"), F.ceil(F.col("short") / 2).cast("int"))
    keyed = sized.select("*", front.alias("front"), back.alias("back")).select(
        "*", F.explode(F.expr("sequence(0, 2)")).alias("band")
    ).select("*", F.posexplode(F.array("front", "back")).alias("side", "half"))
    bucket = F.xxhash64("short", "band", F.col("bands")[F.col("band")], "side", "half")
    keyed = keyed.select(bucket.alias("bucket"), "short", "band", "side", "word", "n", "size", "bands", "front", "back")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    equal = [F.col("a.bands")[i] == F.col("b.bands")[i] for i in range(3)]
    own = F.col("a.band")
    first_band = F.when(own == 0, equal[0]).when(own == 1, ~equal[0] & equal[1]).otherwise(~equal[0] & ~equal[1] & equal[2])
    first_side = F.when(F.col("a.side") == 0, same("front")).otherwise(~same("front") & same("back"))
    # The shorter word's length is the pair's; of two words as long, the smaller comes first.
    ordered = (F.col("a.size") == F.col("a.short")) & ((F.col("b.size") == F.col("a.size") + 1) | ((F.col("b.size") == F.col("a.size")) & (F.col("a.word") < F.col("b.word"))))
    flips = sum((F.bit_count(F.col("a.bands")[i].bitwiseXOR(F.col("b.bands")[i])) for i in range(3)), F.lit(0))
    met = a.join(b, same("bucket") & same("short") & same("band") & same("side") & ordered & first_band & first_side & (flips <= 2))
    one_edit = F.levenshtein("a.word", "b.word", 1) == 1
    return met.filter(one_edit).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of `words` (word, n).

    A form has at least `ratio` times the occurrences, so chains have at most log(n) links; each round doubles what
    a word has followed.
    """
    words = cut(words)
    pairs = cut(near_words(words))
    both = pairs.union(pairs.select(F.col("other"), F.col("other_n"), F.col("word"), F.col("n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.max("other_n").alias("most"),
        F.min(F.struct(-F.col("other_n"), "other")).alias("best"),
    ).select(F.col("word").alias("w"), "n_near", "most", F.col("best.other").alias("other"))
    enough = F.col("most") >= ratio * F.col("n")
    formed = cut(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("most")).alias("form_n"),
    ))
    led = cut(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(led.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        led = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    ends = led.select(F.col("word").alias("w"), F.col("root").alias("end"))
    return formed.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """The variants among the words of `docs`: word, form, root, n, n_near, form_n."""
    return variants(word_counts(docs, least_length, least_count), ratio)


#: CRC-32 is worked out byte by byte over the table of its polynomial; near words share what one deletion leaves.
ORACLE = """
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM hexed, tab),
lost AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN w b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN w b ON a.d = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS most, min(struct_pack(m := -other_n, o := other)) AS b FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * w.n THEN b.o END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
walk AS (SELECT word, word AS here, 0 AS k FROM formed UNION ALL SELECT walk.word, formed.form, k + 1 FROM walk JOIN formed ON formed.word = walk.here WHERE formed.form IS NOT NULL)
SELECT formed.word, form, r.root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(here, k) AS root FROM walk GROUP BY word) r ON r.word = formed.word
"""

"""Fill-in-the-middle: a text is cut twice between tokens, and its middle goes to the end.

Tokens are `[A-Za-z]+|[^A-Za-z]`. An automaton of four states reads code points: it counts the tokens that begin and
sees whether one of the marks `<P>`, `<S>`, `<M>` occurs. A chunk of a text is a function: for each state in which it
may be entered, the state in which it is left, the tokens that begin in it, and whether a mark ends in it. Functions of
neighbouring chunks compose, and composition is associative, so texts longer than a chunk are cut to chunks that all
tasks scan at once; runs of `FAN` chunks are composed, runs of runs, and so on, and the states at entry go back down.
Then each cut selects its chunk by counts, and only there its place is looked up. A text of one chunk is scanned, and
its cuts are looked up, where it lies; it isn't shuffled. The two ways differ in nothing but where the work is done.

Defined results: a null text is empty; an empty text has no token and is plain. A null doc_id counts as the text ''.
Rows that repeat a doc_id and a text get the same result, once a row. Extra columns, whatever their names, are left
out. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, parts, texts

#: The marks, and the shares of texts: fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

#: Code points of a chunk, and chunks of a run.
CHUNK, FAN = 32_768, 64

#: States: outside a word, in a word, after `<`, in a word that is P, S or M and follows `<`.
OUT, WORD, OPEN, NAMED = range(4)
STATES = range(4)
FUNCTION = "ends array<int>, counts array<long>, marks array<boolean>"


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _begins(cp: np.ndarray, entry: int) -> np.ndarray:
    """Which code points begin a token if the chunk is entered in `entry`."""
    letter = ((cp | 32) - np.uint32(97)) < 26
    begins = np.ones(len(cp), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    if len(cp):
        begins[0] = not (letter[0] and entry in (WORD, NAMED))
    return begins


def summary(cp: np.ndarray) -> tuple[list[int], list[int], list[bool]]:
    """The chunk's function: ends, counts and marks by state at entry."""
    if not len(cp):
        return list(STATES), [0] * 4, [False] * 4
    opens, closes, named = cp == ord("<"), cp == ord(">"), np.isin(cp, np.array([ord(c) for c in "PSM"], np.uint32))
    inside = bool((opens[:-2] & named[1:-1] & closes[2:]).any())
    count = int(_begins(cp, OUT).sum())
    joined = count - int(((int(cp[0]) | 32) - 97) in range(26))
    last_letter = ((int(cp[-1]) | 32) - 97) in range(26)
    ends, counts, marks = [], [], []
    for s in STATES:
        after_open = opens[-2] if len(cp) > 1 else s == OPEN
        ends.append(OPEN if opens[-1] else NAMED if named[-1] and after_open else WORD if last_letter else OUT)
        counts.append(joined if s in (WORD, NAMED) else count)
        split = (s == NAMED and closes[0]) or (s == OPEN and len(cp) > 1 and named[0] and closes[1])
        marks.append(inside or bool(split))
    return ends, counts, marks


def _place(cp: np.ndarray, entry: int, rank: int) -> int:
    """Where token `rank`, from 0, of those that begin in the chunk begins; the chunk's end if there is none."""
    at = np.flatnonzero(_begins(cp, entry))
    return int(at[rank]) if rank < len(at) else len(cp)


def _in_place(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Count, mark and both cuts of texts of one chunk."""
    rows = []
    for t, a, b in zip(text, h1.tolist(), h2.tolist(), strict=True):
        cp = points(t)
        at = np.flatnonzero(_begins(cp, OUT))
        n = len(at)
        places = sorted((a % (n + 1), b % (n + 1)))
        rows.append((n, summary(cp)[2][OUT], *[int(at[i]) if i < n else len(cp) for i in places]))
    return pd.DataFrame(rows, columns=["n", "marked", "first", "second"])


def _summaries(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary(points(t)) for t in text], columns=["ends", "counts", "marks"])


def _places(text: pd.Series, entry: pd.Series, ranks: pd.Series) -> pd.Series:
    """Places, in their chunk, of the tokens that a chunk is asked for."""
    out = []
    for t, s, some in zip(text, entry.tolist(), ranks, strict=True):
        cp = points(t)
        out.append([_place(cp, s, int(r)) for r in some])
    return pd.Series(out)


#: A run of functions fs in order: as one function, and what holds where each is entered.
COMPOSED = """aggregate(fs, named_struct('ends', array(0, 1, 2, 3), 'counts', array(0L, 0L, 0L, 0L), 'marks', array(false, false, false, false)),
    (f, g) -> named_struct('ends', transform(f.ends, e -> g.ends[e]), 'counts', zip_with(f.counts, f.ends, (n, e) -> n + g.counts[e]),
                           'marks', zip_with(f.marks, f.ends, (m, e) -> m or g.marks[e])))"""
ENTERED = """aggregate(fs, named_struct('entry', entry0, 'before', before0, 'seen', seen0, 'all', cast(array() as array<struct<pos: bigint, entry: int, before: bigint, seen: boolean>>)),
    (at, g) -> named_struct('entry', g.ends[at.entry], 'before', at.before + g.counts[at.entry], 'seen', at.seen or g.marks[at.entry],
                            'all', concat(at.all, array(named_struct('pos', g.pos, 'entry', at.entry, 'before', at.before, 'seen', at.seen)))), at -> at.all)"""


def entered(functions: DataFrame, fan: int = FAN) -> DataFrame:
    """key, pos, entry, before and seen of `functions` (key, pos, ends, counts, marks): what holds where a chunk is entered.

    Runs of `fan` chunks are composed; what holds at the entry of a run comes from the same scan over runs.
    """
    last = functions.agg(F.max("pos")).first()[0]
    runs = functions.groupBy("key", F.floor(F.col("pos") / fan).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "ends", "counts", "marks"))).alias("fs"))
    start = {"entry0": F.lit(OUT), "before0": F.lit(0).cast("long"), "seen0": F.lit(False)}
    if last is None or last < fan:
        started = runs.withColumns(start)
    else:
        runs = cut(runs)
        above = entered(runs.select("key", F.col("run").alias("pos"), F.expr(COMPOSED).alias("f")).select("key", "pos", "f.*"), fan)
        started = runs.join(above.select("key", F.col("pos").alias("run"), *[F.col(c[:-1]).alias(c) for c in start]), ["key", "run"])
    return started.select("key", F.explode(F.expr(ENTERED)).alias("x")).select("key", "x.*")


def _draws(docs: DataFrame) -> DataFrame:
    """`docs` with h1 to h4 of their ids."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return docs.withColumns({f"h{i}": F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long") for i in range(1, 5)})


def _distributed(long: DataFrame, chunk: int, fan: int) -> DataFrame:
    """`long` (doc_id, text, h1 to h4) with n, marked, first and second, by chunks over all tasks."""
    spark = long.sparkSession
    keyed = long.withColumn("key", F.sha2("text", 256))
    # Copies of a text are scanned once, and only their hashes meet.
    once = keyed.groupBy("key").agg(F.min_by("text", F.length("text")).alias("text"))
    chunks = once.select("key", F.expr(f"explode(sequence(0L, (length(text) - 1) div {chunk}))").alias("pos"), "text").select(
        "key", "pos", F.substring(F.col("text"), (F.col("pos") * chunk + 1).cast("int"), F.lit(chunk)).alias("part")
    )
    dealt = cut(chunks.repartition(parts(spark), "key", "pos").withColumn("f", F.pandas_udf(_summaries, FUNCTION)("part")))
    functions = dealt.select("key", "pos", "f.*")
    at = F.col("entry")
    places = cut(functions.join(entered(functions, fan), ["key", "pos"]).select("key", "pos", "entry", "before", F.col("counts")[at].alias("own"), (F.col("seen") | F.col("marks")[at]).alias("marked")))
    whole = places.groupBy("key").agg(F.sum("own").alias("n"), F.max("marked").alias("marked"))
    asked = (
        keyed.select("doc_id", "key", "h1", "h2").distinct().join(whole, "key")
        .withColumns({"a": F.col("h1") % (F.col("n") + 1), "b": F.col("h2") % (F.col("n") + 1)})
        .select("doc_id", "key", "n", "marked", F.posexplode(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("which", "token"))
    )
    where = places.select("key", "pos", "entry", "before", "own")
    found = cut(
        asked.join(where, "key").filter("token between before and before + own - 1")
        .select("doc_id", "key", "which", "pos", "entry", (F.col("token") - F.col("before")).alias("rank"))
    )
    # A chunk is asked for each of its tokens once at the most, whatever the number of copies.
    wanted = found.groupBy("key", "pos", "entry").agg(F.collect_set("rank").alias("ranks"))
    told = (
        dealt.select("key", "pos", "part").join(wanted, ["key", "pos"])
        .select("key", "pos", F.explode(F.arrays_zip(F.col("ranks"), F.pandas_udf(_places, "array<long>")("part", "entry", "ranks").alias("at"))).alias("x"))
        .select("key", "pos", F.col("x.ranks").alias("rank"), (F.col("pos") * chunk + F.col("x.at")).alias("at"))
    )
    cuts = found.join(told, ["key", "pos", "rank"]).groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("which") == 0, F.col("at"))).alias("first"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("second")
    )
    named = cuts.select(F.col("doc_id").alias("of"), F.col("key").alias("key2"), "first", "second")
    placed = keyed.join(whole, "key").join(named, (F.col("key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    end = F.length("text").cast("long")
    return placed.select("doc_id", "text", "h1", "h2", "h3", "h4", "n", "marked", F.coalesce("first", end).alias("first"), F.coalesce("second", end).alias("second"))


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Each row of `docs`: doc_id, text, n, form, prefix_chars, middle_chars, output.

    `chunk`: code points of a chunk; `fan`: chunks composed at once. Neither changes a result.
    """
    rows = _draws(texts(docs))
    short = rows.filter(F.length("text") <= chunk).withColumn("x", F.pandas_udf(_in_place, "n long, marked boolean, first long, second long")("text", "h1", "h2"))
    columns = ["doc_id", "text", "h3", "h4", "n", "marked", "first", "second"]
    near = short.select("doc_id", "text", "h3", "h4", "x.*").select(columns)
    far = _distributed(rows.filter(F.length("text") > chunk), chunk, fan).select(columns)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    p, m = F.col("first"), F.col("second") - F.col("first")
    return near.union(far).withColumn("form", form).select(
        "doc_id", "text", "n", "form",
        F.when(F.col("form") != "plain", p).alias("prefix_chars"), F.when(F.col("form") != "plain", m).alias("middle_chars"),
        _output(F.col("text"), F.col("form"), p.cast("int"), m.cast("int")).alias("output"),
    )


def _output(text: Column, form: Column, p: Column, m: Column) -> Column:
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and the form alone: no transformed text holds a mark of its own."""
    middle, head = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), 4, 2**31 - 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring(F.substring_index(head, PREFIX, 1), 4, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The contract's columns: output and restored text as hashes."""
    made = fill_in_middle(docs, chunk, fan)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

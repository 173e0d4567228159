"""Substring dedup by recompression: long passages stay in the document with the smallest id.

Rounds of recompression name runs and pairs of equal symbols by hashes of their parts, so names are global
without a dictionary: pass by pass, runs of exactly two equal symbols and then pairs that a hash bit sorts into
left and right become new symbols. Wherever the same 50 words stand, all symbols but those within 9 words of
either end are the same. Among the high-level symbols the smallest of every 29 word places is an anchor, so
every window of 50 words holds an anchor that all its occurrences share, with 16 words around it as its key.

Only keys that two documents share lead on: between shared anchors, whole segments (with the 49 words that
their windows reach) are matched first, by 128-bit hashes; what is left, the edges of repeats and the
occurrences with the smallest id, is matched window by window. A document with the text of a smaller one is
removed at once. Counts and minima are combined before shuffles, so a passage that a third of all documents
share costs a few rows a document.

Defined results: null text has no words. Rows that repeat a doc_id and its text are one document and get the
same result. A document with a null doc_id loses nothing and takes nothing from others. Repeats inside one
document stay. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts
from plumbline.llm.words import hashes, mix, words

#: Words of a window; those at either end that recompression may see otherwise; those around an anchor.
WINDOW, MARGIN, BEFORE, AFTER = 50, 9, 4, 12
#: Places of which one holds an anchor: every place in a window that is clear of the margins.
REACH = WINDOW - MARGIN - AFTER
_NONE = np.uint64(2**64 - 2)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def _rounds(h: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after recompression, and the word at which each starts."""
    symbols, starts, sizes = h, np.arange(len(h)), np.ones(len(h), np.int64)
    for r in range(rounds):
        for kind in ("run", "pair"):
            if len(symbols) < 2:
                return symbols, starts
            if kind == "run":
                same = symbols[1:] == symbols[:-1]
                alone = np.ones(len(same), bool)
                alone[1:] &= ~same[:-1]
                alone[:-1] &= ~same[1:]
                first = np.flatnonzero(same & alone)
            else:
                left = (mix(symbols + np.uint64(r + 1)) >> np.uint64(17)) & np.uint64(1) == 1
                small = sizes <= 2**r
                first = np.flatnonzero((left & small)[:-1] & (~left & small)[1:])
            if not len(first):
                continue
            symbols, sizes = symbols.copy(), sizes.copy()
            symbols[first] = mix(symbols[first] * np.uint64(3) + mix(symbols[first + 1]) + np.uint64(2 * r + (kind == "run")))
            sizes[first] += sizes[first + 1]
            keep = np.ones(len(symbols), bool)
            keep[first + 1] = False
            symbols, starts, sizes = symbols[keep], starts[keep], sizes[keep]
    return symbols, starts


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = best(out[: len(out) - step], out[step:]), have + step
    return out


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in word hashes, the keys of the words around each, and the even values they are chosen by."""
    n = len(h)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    symbols, starts = _rounds(h)
    value = np.full(n, _NONE, np.uint64)
    value[starts] = np.minimum(mix(symbols ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & _NONE, _NONE - np.uint64(2))
    low = _sliding(value, REACH, np.minimum)
    padded = np.concatenate([np.zeros(REACH - 1, np.uint64), low, np.zeros(REACH - 1, np.uint64)])
    at = np.flatnonzero((value == _sliding(padded, REACH, np.maximum)) & (value != _NONE))
    at = at[(at >= BEFORE) & (at <= n - AFTER)]
    return at, _ranges(h, at - BEFORE, at + AFTER, 0), value


def _prefixes(h: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[i] * step**i, and the powers of the step's inverse."""
    n = len(h) + 1
    step = _STEP[kind]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, step, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(step), -1, 2**64)), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(kind)) * power[:-1])])
    return sums, back


def _ranges(h: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the word sequences [begin, end)."""
    sums, back = _prefixes(h, kind)
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _sha(some: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(some)).hexdigest()


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 (hashes of the text), n_words, sha of all words, and the keys of its anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                w = words(t, lower=False)
                keys = anchors(hashes(w))[1] if len(w) >= WINDOW else np.empty(0, np.uint64)
                rows.append((len(w), _sha(w), np.unique(_signed(keys))))
            out = batch[["doc_id", "f1", "f2"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["n_words"], out["sha"], out["keys"] = zip(*rows, strict=True) if rows else ((), (), ())
            yield out

    return _identified(docs).mapInPandas(run, "doc_id long, f1 long, f2 long, n_words long, sha string, keys array<long>")


def _identified(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumns({"f1": F.xxhash64("text"), "f2": F.xxhash64("text", F.lit("whole"))})


def _pieces(suspects: DataFrame) -> DataFrame:
    """Runs of windows to match: doc_id, f1, first, last (starts), h1, h2 (of their words), one row per segment.

    suspects: doc_id, f1, text, shared (its keys that other documents hold). A window is worth a look when
    the smallest symbol in its middle, which is an anchor wherever the window stands, has a shared key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, f1, text, shared in zip(batch["doc_id"], batch["f1"], batch["text"], batch["shared"], strict=True):
                h = hashes(words(text, lower=False))
                at, keys, value = anchors(h)
                begin, end = _segments(at, np.isin(_signed(keys), np.asarray(shared, np.int64)), value)
                if len(begin):
                    stop = end + WINDOW
                    out.append(
                        pd.DataFrame({"doc_id": doc_id, "f1": f1, "first": begin, "last": end}).assign(
                            h1=_signed(_ranges(h, begin, stop, 0)), h2=_signed(_ranges(h, begin, stop, 1))
                        )
                    )
            if out:
                yield pd.concat(out)

    return suspects.mapInPandas(run, "doc_id long, f1 long, first long, last long, h1 long, h2 long")


def _segments(at: np.ndarray, known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the runs of windows worth a look, cut where anchors lie."""
    starts = len(value) - WINDOW + 1
    marked = value | np.uint64(1)
    marked[at[known]] ^= np.uint64(1)
    low = _sliding(marked, REACH, np.minimum)[MARGIN : MARGIN + starts]
    look = low & np.uint64(1) == 0
    cuts = np.zeros(starts, bool)
    cuts[at[at < starts]] = True
    begin, close = look.copy(), look.copy()
    begin[1:] &= ~look[:-1] | cuts[1:]
    close[:-1] &= ~look[1:] | cuts[1:]
    return np.flatnonzero(begin), np.flatnonzero(close)


def _windows(suspects: DataFrame) -> DataFrame:
    """One row per window of the runs in `runs` (first, last): doc_id, f1, first, h1, h2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, f1, text, runs in zip(batch["doc_id"], batch["f1"], batch["text"], batch["runs"], strict=True):
                h = hashes(words(text, lower=False))
                s = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs])
                out.append(
                    pd.DataFrame({"doc_id": doc_id, "f1": f1, "first": s}).assign(
                        h1=_signed(_ranges(h, s, s + WINDOW, 0)), h2=_signed(_ranges(h, s, s + WINDOW, 1))
                    )
                )
                if len(out) == 256:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    return suspects.mapInPandas(run, "doc_id long, f1 long, first long, h1 long, h2 long")


def _earliest(rows: DataFrame) -> DataFrame:
    """h1, h2 and the smallest doc_id, of what stands in more documents than one.

    Written, so that a join with it reads both sides from plain exchanges and Spark can split a very common passage.
    """
    return cut(
        rows.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"))
        .filter("owner < other")
        .select("h1", "h2", "owner")
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Every row of `docs`: doc_id, n_words, n_removed, kept_sha256."""
    base = cut(summaries(docs))
    # Written for the same reason: a text of many copies is split.
    first = cut(base.filter("doc_id is not null and n_words > 0").groupBy("f1", "f2", "n_words").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).filter("owner < other").drop("other"))
    named = cut(base.join(first, ["f1", "f2", "n_words"], "left"))
    own = named.filter("doc_id = coalesce(owner, doc_id) and size(keys) > 0").select("doc_id", "f1", F.explode("keys").alias("key"))
    shared = cut(own.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key"))
    keys = own.join(shared, "key").groupBy("doc_id", "f1").agg(F.collect_list("key").alias("shared"))
    suspects = cut(
        texts(docs).withColumn("f1", F.xxhash64("text")).join(keys.hint("shuffle_hash"), ["doc_id", "f1"]).dropDuplicates(["doc_id", "f1"])
    )
    segments = cut(_pieces(suspects))
    taken = segments.join(_earliest(segments), ["h1", "h2"], "left").select(
        "doc_id", "f1", "first", "last", (F.col("owner") < F.col("doc_id")).alias("gone")
    )
    taken = cut(taken.withColumn("gone", F.coalesce("gone", F.lit(False))))
    runs = taken.filter("not gone").groupBy("doc_id", "f1").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    # Not written: it is the largest table here; owners of windows are written, so that windows can be split.
    single = _windows(suspects.join(runs, ["doc_id", "f1"]))
    late = single.join(_earliest(single), ["h1", "h2"]).filter("owner < doc_id").select("doc_id", "f1", "first", F.col("first").alias("last"))
    gone = taken.filter("gone").select("doc_id", "f1", "first", "last").union(late)
    spans = gone.groupBy("doc_id", "f1").agg(F.collect_list(F.struct("first", "last")).alias("gone"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["gone"], strict=True):
                w = words(text, lower=False)
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, [s["first"] for s in spans], 1)
                np.add.at(change, [s["last"] + WINDOW for s in spans], -1)
                out = np.cumsum(change)[:-1] > 0
                rows.append((int(out.sum()), _sha([x for x, o in zip(w, out, strict=True) if not o])))
            made = batch[["doc_id", "f1"]].copy()
            made["n_gone"], made["sha_kept"] = zip(*rows, strict=True) if rows else ((), ())
            yield made

    partly = suspects.join(spans, ["doc_id", "f1"]).mapInPandas(strip, "doc_id long, f1 long, n_gone long, sha_kept string")
    copy = F.coalesce((F.col("n_words") >= WINDOW) & (F.col("doc_id") > F.col("owner")), F.lit(False))
    return named.join(partly, ["doc_id", "f1"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS owner FROM v GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM v JOIN f USING (h) WHERE owner < doc_id),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w),
m AS (SELECT t.doc_id, t.x, t.k, g.k IS NOT NULL AS gone FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.k = t.k),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""

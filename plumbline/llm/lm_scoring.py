"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class). The most frequent tokens are classes of their own; all
others share classes by their form. The class distribution is log-linear in hashed features of the context: the word
before, skips to the word two and three before, and the pair of both neighbours. Each kind of feature has rows of its
own, whose number grows with the distinct training tokens up to MOST_ROWS. They are trained by distributed gradient
updates: in each round every partition of the training documents makes minibatch updates from the shared weights, and
the rows that it touched are averaged over partitions, FAN of them at a time. Every training document is used in one
round. Within a class, P(token | class, context) is log-linear too: over the training counts plus one (one more place
is for unknown tokens), it has a weight for each token of the head, and for a class's others together, after each class of
the word before. Gradients of these weights follow from how often each token has each class before it in all training
documents; the tasks of the rounds sum that up beside their updates, and the driver, which holds CLASSES numbers a token of
the head, climbs to the maximum.

Counts of all tokens are kept as a table by token, which grows with the corpus. The `head` most frequent go to tasks; a document's
other tokens meet the table in a join by token, after equal tokens of a document are combined.

Defined results: null text is empty, and has one token, its end. Rows that repeat a doc_id and its text get the
same result. Without training documents all scores follow from empty counts. Averages depend, within their spread, on
how Spark partitions the documents. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, frequent, held_out, texts
from plumbline.llm.words import KEPT, mix

#: Classes: SINGLE tokens of their own, then classes by form, the last one for ends.
SINGLE, CLASSES = 8, 32
#: Kinds of features; hashed rows of weights a kind, at least and at most; rows a shuffled block holds; blocks averaged at once.
KINDS, LEAST_ROWS, MOST_ROWS, BLOCK, FAN = 4, 1024, 16_384, 256, 128
#: Frequent tokens that go to tasks; rounds; tokens of a minibatch; step.
HEAD, ROUNDS, BATCH, STEP = 65_536, 2, 16_384, 0.1
#: Steps to the weights within classes, and their ridge.
CLIMBS, RIDGE = 30, 1.0
_FORM = CLASSES - SINGLE
_START = np.uint64(0x0123456789ABCDE0)
_SLOT = np.uint64(44)
_ONES = np.ones(CLASSES, np.float32)


def _form(word: bytes) -> int:
    """The class of a word by its last letters, its mark, or its digits."""
    if word[-1:].isdigit():
        return SINGLE
    stem = word.rstrip(b".,;:!?|*#$%&\"')")
    if not stem:
        return SINGLE + 1
    return SINGLE + 2 + xxhash.xxh32_intdigest(stem[-3:] + (word[-1:] if stem != word else b"")) % (_FORM - 3)


class _Codes(dict):
    """Words to 64-bit hashes whose last bits hold the class by form."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, 7) & ~63 | _form(word)
        if len(self) < KEPT:
            self[word] = code
        return code


_codes = _Codes()
#: The end of a text; no word has its class by form.
END = 0xFEDCBA98765432C0 | (CLASSES - 1)


def _tokens(text: str) -> np.ndarray:
    w = text.encode().lower().split()
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_codes.__getitem__, w), np.uint64, len(w))
    out[-1] = END
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """code and c of every token of `docs` (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                some = batch["text"].iloc[i : i + 2048]
                if len(some):
                    codes, c = np.unique(np.concatenate([_tokens(t) for t in some]), return_counts=True)
                    yield pd.DataFrame({"code": codes.astype(np.int64), "c": c})

    return docs.select("text").mapInPandas(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def rows_for(distinct: int) -> int:
    """Rows of weights a kind of feature, a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << math.ceil(math.log2(max(1, distinct / 8)))))


class Model:
    """Head counts, class sizes and weights (a copy, as single floats), as tasks use them."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, mass: np.ndarray, kinds: np.ndarray, weights: np.ndarray, bias: np.ndarray, inner: np.ndarray | None = None):
        # inner: by place in the head, then by class for tokens beside it, weights after each class of the word before.
        # head: sorted codes; the SINGLE most frequent have classes of their own.
        self.head, self.counts, self.weights, self.bias = head, counts, weights.astype(np.float32), bias
        self.classes = (head & np.uint64(63)).astype(np.int64)
        self.classes[np.argsort(-counts, kind="stable")[:SINGLE]] = np.arange(min(SINGLE, len(head)))
        self.size = np.log10(mass + kinds + 1.0)
        self.single = np.arange(CLASSES) < SINGLE
        self.own = np.append(self.classes, np.arange(CLASSES))
        self.base = np.append(counts + 1.0, np.maximum(mass + kinds + 1.0 - np.bincount(self.classes, counts + 1.0, CLASSES), 0)).astype(np.float32)
        self.inner = (np.zeros((len(head) + CLASSES, CLASSES)) if inner is None else inner).astype(np.float32)
        self.total = self.totals(self.base[:, None] * np.exp(self.inner))
        # Places by the first bits of codes; those that share them are looked up among all.
        slots = (head >> _SLOT).astype(np.int64)
        self.slots, self.shared = np.full(1 << 20, -1, np.int32), np.bincount(slots, minlength=1 << 20) > 1
        self.slots[slots] = np.arange(len(head))

    def totals(self, x: np.ndarray) -> np.ndarray:
        """Sums of rows by class."""
        order = np.argsort(self.own, kind="stable")
        return np.add.reduceat(x.take(order, axis=0), np.searchsorted(self.own[order], np.arange(CLASSES)), axis=0, dtype=np.float64)

    def rows(self, classes: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its row of weights within its class, and the class of the word before; a text begins after an end."""
        before = np.concatenate([[CLASSES - 1], classes[:-1]])
        before[starts] = CLASSES - 1
        return np.where(at >= 0, at, len(self.head) + classes), before

    def within(self, classes: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P(token | class, context), less log10 of the token's count plus one."""
        rows, before = self.rows(classes, at, starts)
        return (self.inner[rows, before] - np.log(np.maximum(self.total, 1e-9))[classes, before]) / math.log(10)

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and places in the head or -1."""
        slot = (codes >> _SLOT).astype(np.int64)
        at = self.slots.take(slot).astype(np.int64)
        hit = (at >= 0) & (self.head.take(at, mode="wrap") == codes)
        rest = np.flatnonzero(~hit & self.shared.take(slot))
        at[rest] = np.minimum(np.searchsorted(self.head, codes[rest]), len(self.head) - 1)
        hit[rest] = self.head.take(at[rest]) == codes[rest]
        return np.where(hit, self.classes[at], (codes & np.uint64(63)).astype(np.int64)), np.where(hit, at, -1)


def _features(docs: list[np.ndarray], rows: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All tokens of the documents, rows of weights for each feature of their contexts, and where documents start."""
    flat = np.concatenate(docs)
    starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])

    def earlier(x: np.ndarray) -> np.ndarray:
        out = np.concatenate([[_START], x[:-1]])
        out[starts] = _START
        return out

    one = earlier(flat)
    two = earlier(one)
    three = earlier(two)
    contexts = (one + np.uint64(1), two + np.uint64(2), three + np.uint64(3), one * np.uint64(3) + mix(two))
    return flat, [(mix(x) & np.uint64(rows - 1)).astype(np.int64) + k * rows for k, x in enumerate(contexts)], starts


def _shifted(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray], at: slice) -> np.ndarray:
    """Logarithms of what classes' probabilities are in proportion to, 0 at the most."""
    z = weights.take(features[0][at], axis=0)
    z += bias
    for f in features[1:]:
        z += weights.take(f[at], axis=0)
    most = z
    while most.shape[1] % 2 == 0:
        most = np.maximum(most[:, : most.shape[1] // 2], most[:, most.shape[1] // 2 :])
    z -= most.max(axis=1, keepdims=True)
    return z


def _log_p(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray], at: slice) -> np.ndarray:
    z = _shifted(weights, bias, features, at)
    z -= np.log(np.exp(z) @ _ONES)[:, None]
    return z


def _p(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray], at: slice) -> np.ndarray:
    z = _shifted(weights, bias, features, at)
    np.exp(z, out=z)
    z /= (z @ _ONES)[:, None]
    return z


def _in_batches(texts_: list[str], most: int) -> Iterator[list[np.ndarray]]:
    some, n = [], 0
    for t in texts_:
        some.append(_tokens(t))
        n += len(some[-1])
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def _packed(task: int, w: np.ndarray, touched: np.ndarray) -> pd.DataFrame:
    """The touched rows of weights, a row a block: their places in it, their weights, and how many tasks touched each."""
    out = []
    for b in range(0, len(w), BLOCK):
        at = np.flatnonzero(touched[b : b + BLOCK])
        if len(at):
            out.append((task, b, at.astype(np.uint8).tobytes(), w[b + at].astype(np.float16).tobytes(), touched[b + at].astype(np.float32).tobytes()))
    return pd.DataFrame(out, columns=["task", "block", "places", "w", "touched"])


def _unpacked(places: bytes, w: bytes, touched: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(places, np.uint8).astype(np.int64), np.frombuffer(w, np.float16).reshape(-1, CLASSES), np.frombuffer(touched, np.float32)


def _packed_counts(task: int, n: np.ndarray) -> pd.DataFrame:
    """Counts that aren't 0, a row a block, whose number is less than 0: their places in it, and the counts."""
    out = []
    for b in range(0, len(n), BLOCK * CLASSES):
        at = np.flatnonzero(n[b : b + BLOCK * CLASSES])
        if len(at):
            c = n[b + at]
            out.append((task, -1 - b, at.astype(np.uint16).tobytes(), c.astype(np.min_scalar_type(c.max())).tobytes(), b""))
    return pd.DataFrame(out, columns=["task", "block", "places", "w", "touched"])


def _unpacked_counts(places: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(places, np.uint16)
    return at.astype(np.int64), np.frombuffer(c, f"u{len(c) // len(at)}").astype(np.int64)


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: of weights, the means of rows, by how many tasks touched each; of counts, the sums."""
    if rows["block"].iloc[0] < 0:
        n = np.zeros(BLOCK * CLASSES, np.int64)
        for packed in zip(rows["places"], rows["w"], strict=True):
            at, c = _unpacked_counts(*packed)
            n[at] += c
        return _packed_counts(rows["task"].iloc[0], n).assign(block=rows["block"].iloc[0])
    total, touched = np.zeros((BLOCK, CLASSES), np.float32), np.zeros(BLOCK, np.float32)
    for packed in zip(rows["places"], rows["w"], rows["touched"], strict=True):
        at, w, n = _unpacked(*packed)
        total[at] += w * n[:, None]
        touched[at] += n
    total /= np.maximum(touched, 1)[:, None]
    return _packed(rows["task"].iloc[0], total, touched).assign(block=rows["block"].iloc[0])


def _round(train: DataFrame, shared, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one round of updates on `train` (text), averaged over the tasks that touched a row; how often each
    row of weights within classes (a token of the head, a class's others) has each class before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        w, energy, n = model.weights, np.zeros(KINDS * rows, np.float32), np.zeros(model.inner.size, np.int64)
        for batch in batches:
            for docs in _in_batches(list(batch["text"]), 8 * BATCH):
                flat, features, starts = _features(docs, rows)
                classes, places = model.look(flat)
                own, before = model.rows(classes, places, starts)
                np.add.at(n, own * CLASSES + before, 1)
                for i in range(0, len(flat), BATCH):
                    at = slice(i, i + BATCH)
                    g = _p(w, model.bias, features, at)
                    g[np.arange(len(g)), classes[at]] -= 1
                    for k, f in enumerate(features):
                        order = np.argsort((f[at] - k * rows).astype(np.uint16), kind="stable")
                        own = f[at].take(order)
                        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        own = own.take(first)
                        step = np.add.reduceat(g.take(order, axis=0), first, axis=0)
                        energy[own] += (step * step) @ _ONES / CLASSES
                        step *= (STEP / np.sqrt(energy[own] + 1e-3))[:, None]
                        w[own] -= step
        yield _packed(TaskContext.get().partitionId(), w, (energy > 0).astype(np.float32))
        yield _packed_counts(TaskContext.get().partitionId(), n)

    kind = "task int, block int, places binary, w binary, touched binary"
    made = train.select("text").mapInPandas(run, kind)
    # Means and sums of FAN tasks, of FAN such groups, and of what is left.
    for _ in range(2):
        made = made.withColumn("task", F.expr(f"cast(task div {FAN} as int)")).groupBy("task", "block").applyInPandas(_mean, kind)
    made = made.groupBy("block").applyInPandas(_mean, kind)
    out, n = shared.value[4].copy(), np.zeros((len(shared.value[0]) + CLASSES) * CLASSES, np.int64)
    for r in made.toLocalIterator():
        if r.block < 0:
            at, c = _unpacked_counts(r.places, r.w)
            n[-1 - r.block + at] = c
        else:
            at, w, _ = _unpacked(r.places, r.w, r.touched)
            out[r.block + at] = w
    return out, n


def _climbed(model: Model, n: np.ndarray) -> np.ndarray:
    """Weights within classes of the greatest likelihood of `n` (rows of weights by classes before), less a ridge."""
    w, found = model.inner, model.totals(n)
    for _ in range(CLIMBS):
        e = model.base[:, None] * np.exp(w)
        e *= (found / np.maximum(model.totals(e), 1e-9)).astype(np.float32)[model.own]
        w = w + np.clip((n - e - RIDGE * w) / (np.maximum(e, n) + RIDGE), -1, 1)
    return w


def trained(train: DataFrame, counts: DataFrame):
    """The fitted model's parts, broadcast, with the number of training tokens N and of distinct ones V."""
    spark = train.sparkSession
    end_code = int(np.uint64(END).astype(np.int64))
    top = frequent(counts.filter(F.col("code") != end_code), "c", HEAD).collect()
    end = counts.filter(F.col("code") == end_code).first()
    pairs = sorted([(int(np.int64(r.code).astype(np.uint64)), r.c) for r in top] + [(END, end.c if end else 0)])
    head, c = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
    by_class = counts.groupBy(F.expr("cast(code & 63 as int)").alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        mass[r["class"]], kinds[r["class"]] = r.c, r.kinds
    n, v = int(mass.sum()), int(kinds.sum())
    rows = rows_for(v)
    model = Model(head, c, mass, kinds, np.zeros((KINDS * rows, CLASSES), np.float16), np.zeros(CLASSES, np.float32))
    for i in np.flatnonzero(model.classes < SINGLE):
        form = int(head[i] & np.uint64(63))
        mass[form] -= c[i]
        kinds[form] -= c[i] > 0
        mass[model.classes[i]], kinds[model.classes[i]] = c[i], 1
    bias = np.log((mass + 1) / (n + CLASSES)).astype(np.float32)
    weights, follows = model.weights.astype(np.float16), 0
    for r in range(ROUNDS):  # every document is in one
        shared = spark.sparkContext.broadcast((head, c, mass, kinds, weights, bias))  # bounded by HEAD, MOST_ROWS, CLASSES
        weights, found = _round(train.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == r), shared, rows)
        follows = follows + found
    model = Model(head, c, mass, kinds, weights, bias)
    inner = _climbed(model, follows.reshape(model.inner.shape).astype(np.float32)).astype(np.float16)
    return spark.sparkContext.broadcast((head, c, mass, kinds, weights, bias, inner)), n, v


def score(docs: DataFrame, fold: tuple[int, int] = (7, 2)) -> DataFrame:
    """Every row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = texts(docs).withColumn("held_out", held_out(*fold))
    train = rows.filter("not held_out")
    counts = cut(token_counts(train))
    shared, n, v = trained(train, counts)
    bottom = math.log10(n + 1 * (v + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        logs, per_kind = np.log10(model.counts + 1.0), len(model.weights) // KINDS
        for batch in batches:
            done = 0
            for docs in _in_batches(list(batch["text"]), BATCH):
                flat, features, starts = _features(docs, per_kind)
                classes, at = model.look(flat)
                p = np.empty(len(flat))
                for i in range(0, len(flat), BATCH):
                    z = _log_p(model.weights, model.bias, features, slice(i, i + BATCH))
                    p[i : i + len(z)] = z[np.arange(len(z)), classes[i : i + BATCH]]
                p /= math.log(10)
                in_head, alone = at >= 0, model.single[classes]
                count_log = np.where(in_head, logs[at], 0.0)
                p += np.where(alone, 0.0, count_log + model.within(classes, at, starts))
                part = batch.iloc[done : done + len(docs)]
                done += len(docs)
                tail = [np.unique(d[~in_head[s : s + len(d)]].astype(np.int64), return_counts=True) for d, s in zip(docs, starts, strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "f1": part["f1"].to_numpy(),
                        "held_out": part["held_out"].to_numpy(),
                        "n_tokens": [len(d) for d in docs],
                        "known": np.add.reduceat((in_head & (model.counts[at] > 0)).astype(np.int64), starts),
                        "base": np.add.reduceat(count_log, starts),
                        "own": np.add.reduceat(p, starts),
                        "codes": [t[0] for t in tail],
                        "times": [t[1] for t in tail],
                    }
                )

    kind = "doc_id long, f1 long, held_out boolean, n_tokens long, known long, base double, own double, codes array<long>, times array<long>"
    scored = cut(rows.withColumn("f1", F.xxhash64("text")).mapInPandas(run, kind))
    rare = scored.select("doc_id", "f1", F.explode(F.arrays_zip("codes", "times")).alias("t")).select("doc_id", "f1", F.col("t.codes").alias("code"), F.col("t.times").cast("int").alias("times"))
    found = (
        rare.join(counts, "code")
        .groupBy("doc_id", "f1")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"), F.count("*").alias("kinds"))
        .join(scored.groupBy("doc_id", "f1").agg(F.count("*").alias("copies")).filter("copies > 1"), ["doc_id", "f1"], "left")
    )
    again = F.coalesce("copies", F.lit(1))
    found = found.select(F.col("doc_id").alias("d"), F.col("f1").alias("f"), (F.col("more") / again).alias("more"), (F.col("more_known") / again).cast("long").alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.drop("codes", "times").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("f1") == F.col("f")), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * bottom).alias("base_score"), (F.col("own") + more).alias("score"),
    )

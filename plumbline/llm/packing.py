"""Best-fit packing: token pieces into as few sequences of bounded length as it can.

Documents are tokenised where they lie; what is shuffled afterwards are piece lengths alone. Pieces are dealt
into groups that each give one task a bounded number of pieces, and each group is packed by bounded-space
best-fit: a fixed number of open bins in a bitset keyed by free space; where a piece fits in none, a bin opens,
and the fullest open bin closes first. A group's pieces come in seeded random order, in blocks of as many pieces
as bins may be open, longest first within a block: so long pieces meet short ones before their bins close.

Defined results: null text is empty; an empty text still has its end id and so one piece of length 1. Rows that
repeat a doc_id are packed each on its own. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts

#: A process remembers the ids of so many words; beyond that it starts afresh.
CACHED = 600_000
#: Documents, and new words, that are encoded at once.
AT_ONCE, TOGETHER = 256, 2_000
_known: dict[str, tuple] = {}
#: Marks that words may end with.
_MARKS = ".,;:!?|*#$%&()[]{}<>=+-_/~^\""
#: White space of Unicode other than spaces and line feeds.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def _encoder(path: str):
    """A function from a list of texts to their ids as little-endian uint32 bytes.

    The tokenizer cuts texts before a single space or line feed that stands between other characters, after a line
    feed, and between a letter or digit and marks after it. So words can be encoded alone, those after a space with
    it, marks at their ends apart, and remembered. Texts with other runs of white space, or with the text of a special
    token, are encoded whole.
    """
    if path not in _known:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        odd = ("  ", " \n", "\n ", "\n\n\n", *(t.content for t in tokenizer.get_added_tokens_decoder().values()), *_OTHER_SPACE)
        _known[path] = (tokenizer, odd, tuple(x for x in odd if x.isascii()), {})
    tokenizer, odd, ascii_odd, cache = _known[path]
    (line_feed,) = tokenizer.encode("\n", add_special_tokens=False).ids
    feed = np.array([line_feed], "<u4").tobytes()

    def ids(some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def of_lines(some: list[str]) -> list[bytes]:
        """Ids of lines that aren't empty; of many at once, told apart by the line feeds between them."""
        out = []
        for e in tokenizer.encode_batch_fast(["\n".join(some[i : i + TOGETHER]) for i in range(0, len(some), TOGETHER)], add_special_tokens=False):
            found = np.array(e.ids, "<u4")
            flat = found.tobytes()
            ends = [*(4 * np.flatnonzero(found == line_feed)).tolist(), len(flat)]
            starts = [0, *[x + 4 for x in ends[:-1]]]
            out += [flat[s:e] for s, e in zip(starts, ends, strict=True)]
        return out

    def learn(keys: set[str]) -> None:
        """Puts keys into the cache: a line feed and the word after it, or a word after a space."""
        parts = []
        for key in keys:
            body = key.rstrip(_MARKS)
            parts.append((key, body, key[len(body) :]) if body != key and body[-1:].isalnum() else (key, key, ""))
        new = list({body for _, body, _ in parts}.difference(cache))
        cache.update(zip(new, of_lines([k[1:] if k[0] == "\n" else f" {k}" for k in new]), strict=True))
        for k in new:
            if k[0] == "\n":
                cache[k] = feed + cache[k]
        tails = list({tail for _, _, tail in parts if tail})
        marks = dict(zip(tails, ids(tails), strict=True))
        cache.update((key, cache[body] + marks[tail]) for key, body, tail in parts if tail)

    def encode(some: list[str]) -> list[bytes]:
        out: list = [None] * len(some)
        spaced: dict[int, list[str]] = {}
        whole = []
        for i, text in enumerate(some):
            if text.endswith("\n\n") or any(x in text for x in (ascii_odd if text.isascii() else odd)):
                whole.append(i)
            else:
                spaced[i] = text.replace("\n", " \n").split(" ")
        # The first word of a text has no space before it.
        alone = iter(ids([some[i] for i in whole] + [w[0] for w in spaced.values()]))
        for i in whole:
            out[i] = next(alone)
        for i, w in spaced.items():
            out[i] = next(alone)
            del w[0]
        if len(cache) > CACHED or not cache:
            cache.clear()
            cache.update(zip(("\n", ""), ids(["\n", " "]), strict=True))
        learn(set().union(*spaced.values()).difference(cache))
        for i, w in spaced.items():
            out[i] += b"".join(map(cache.__getitem__, w))
        return out

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian uint32) if asked for.

    A document longer than `length` is cut so that all pieces but the first are full.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows = []
            some = list(batch["text"])
            encoded = (b for i in range(0, len(some), AT_ONCE) for b in encode(some[i : i + AT_ONCE]))
            for doc_id, b in zip(batch["doc_id"], encoded, strict=True):
                b += end
                n = len(b) // 4
                ends = range(n - (n - 1) // length * length, n + 1, length)
                for k, e in enumerate(ends):
                    s = e - length if k else 0
                    part = b[4 * s : 4 * e]
                    rows.append((doc_id, k, s, e - s, zlib.crc32(part), *[part] * with_ids))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return texts(docs).mapInPandas(cut_up, schema)


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the given order, by bounded-space best-fit."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    levels, n_open, n_bins = 0, 0, 0
    bins, offsets = [], []
    for need in lengths:
        fit = levels >> need
        if fit:
            free = need + ((fit & -fit).bit_length() - 1)
            at = by_free[free].pop()
            if not by_free[free]:
                levels &= ~(1 << free)
        else:
            if n_open == open_bins:
                fullest = (levels & -levels).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    levels &= ~(1 << fullest)
                n_open -= 1
            free, at = size, n_bins
            n_bins += 1
            n_open += 1
        bins.append(at)
        offsets.append(size - free)
        if free == need:
            n_open -= 1
        else:
            by_free[free - need].append(at)
            levels |= 1 << (free - need)
    return bins, offsets


def _order(rows: pd.DataFrame, block: int, seed: int) -> pd.DataFrame:
    """Rows in seeded random order, then longest first within each block of `block` rows."""
    rows = rows.sort_values(["doc_id", "piece", "length", "ids_crc32"])
    rows = rows.iloc[np.random.default_rng(seed).permutation(len(rows))]
    return rows.iloc[np.lexsort((-rows["length"].to_numpy(), np.arange(len(rows)) // block))]


def pack(made: DataFrame, length: int = 1024, open_bins: int = 512, group: int = 50_000) -> DataFrame:
    """`made` with sequence_id and offset. Full pieces are sequences of their own and never travel.

    `group`: pieces a task packs at once, about.
    """
    spark = made.sparkSession
    full, rest = made.filter(F.col("length") >= length), made.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _order(rows, open_bins, int(key[0]))
        bins, offsets = best_fit(rows["length"].tolist(), length, open_bins)
        # Even numbers for packed sequences, odd ones for full pieces.
        rows["sequence_id"] = ((np.int64(key[0]) << 36) + np.array(bins, np.int64)) * 2
        rows["offset"] = np.array(offsets, np.int64)
        return rows.drop(columns="pack_group")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    packed = rest.withColumn("pack_group", spread).groupBy("pack_group").applyInPandas(
        fit, schema + ", sequence_id long, offset long"
    )
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, length: int = 1024, open_bins: int = 512) -> DataFrame:
    """Every piece of `docs` with its place: the columns of the contract."""
    made = cut(pieces(docs, tokenizer_path or default_tokenizer(), length=length))
    return pack(made, length, open_bins)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian uint32 bytes) of each sequence, from placed pieces that hold their ids."""
    return placed.groupBy("sequence_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(offset, ids))), x -> hex(x.ids)), '')").alias("hex")
    ).select("sequence_id", F.unhex("hex").alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

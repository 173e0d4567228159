"""Streaming operators: debounce, sliding-window admission, keyframe sampling, versioned late evidence.

Each works on a streaming or a batch DataFrame with an event-time column, so that the batch form is its oracle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.seq import in_order


def settled(arrivals: DataFrame, key: str, at: str, settle: str, watermark: str = "0 seconds") -> DataFrame:
    """(key, first, last, n) of each burst of arrivals, once no more came for `settle`: a session window."""
    stream = arrivals.withWatermark(at, watermark) if arrivals.isStreaming else arrivals
    by = stream.groupBy(key, F.session_window(at, settle).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return by.drop("w")


def windowed_counts(events: DataFrame, keys: list[str], at: str, size: str, slide: str | None = None, watermark: str = "0 seconds") -> DataFrame:
    """Counts in tumbling, or sliding, event-time windows."""
    stream = events.withWatermark(at, watermark) if events.isStreaming else events
    by = stream.groupBy(F.window(at, size, slide or size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return by.select(*keys, F.col("w.start").alias("start"), "n")


def trailing_counts(events: DataFrame, key: str, at: str, seconds: float, limit: int) -> DataFrame:
    """Batch form of a strict limiter: each event with the number of events in its trailing window, and over_limit."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = W.partitionBy(key).orderBy(micros).rangeBetween(-int(seconds * 1e6) + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("over_limit", F.col("in_window") > limit)


def admitted(events: DataFrame, key: str, order: str, at: str, seconds: float, limit: int) -> DataFrame:
    """(key, order, admitted): at most `limit` admitted events of a key in any trailing window; refused ones don't count.

    State is the times of the admitted events still in the window, at most `limit` of them. Events of a key are
    taken in the order of `at`, then `order`, within a batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean"

    def admit(times: list[float], row) -> tuple:
        t = getattr(row, at).timestamp()
        times[:] = [x for x in times if x > t - seconds]
        fits = len(times) < limit
        if fits:
            times.append(t)
        return getattr(row, key), getattr(row, order), fits

    if not events.isStreaming:
        return in_order(events, key, [at, order], list, admit, out)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, order], kind="stable")
        yield pd.DataFrame([admit(times, row) for row in rows.itertuples(index=False)], columns=[key, order, "admitted"])
        state.update((times,))

    return events.groupBy(key).applyInPandasWithState(step, out, "times array<double>", "append", GroupStateTimeout.NoTimeout)


def sampled(
    frames: DataFrame, key: str, order: str, at: str, value: str, least_gap: float, most_gap: float, least_move: float, heading: str | None = None, least_turn: float = 8.0
) -> DataFrame:
    """(key, order) of frames kept: the first; then after most_gap, or after least_gap with a move or a turn, since the last kept.

    heading, in degrees, is turned in either direction; without one nothing turns.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}"
    where = heading or value

    def keep(last: list[float], row) -> tuple | None:
        t, v, h = getattr(row, at).timestamp(), float(getattr(row, value)), float(getattr(row, where))
        if last:
            gap, turn = t - last[0], abs(h - last[2]) % 360 if heading else 0.0
            if gap < most_gap and (gap < least_gap or (abs(v - last[1]) < least_move and min(turn, 360 - turn) < least_turn)):
                return None
        last[:] = [t, v, h]
        return getattr(row, key), getattr(row, order)

    if not frames.isStreaming:
        return in_order(frames, key, [at, order], list, keep, out)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, order], kind="stable")
        kept = [keep(last, row) for row in rows.itertuples(index=False)]
        yield pd.DataFrame([k for k in kept if k is not None], columns=[key, order])
        state.update(tuple(last))

    return frames.groupBy(key).applyInPandasWithState(step, out, "at double, value double, heading double", "append", GroupStateTimeout.NoTimeout)


def due(bundles: DataFrame, arrivals: DataFrame, key: str, now: Column, settle: float) -> DataFrame:
    """(key, version, why) of what is to be processed: the latest bundle of a key, complete and not yet processed as it is.

    bundles: key, version, complete, manifest, processed (the manifest that was), photos. arrivals: key, at. why: photos
    (no wait), nothing came, or settled: the newest arrival lies `settle` seconds back.
    """
    last = bundles.groupBy(key).agg(F.max_by(F.struct("version", "complete", "manifest", "processed", "photos"), "version").alias("b")).select(key, "b.*")
    ready = last.filter("complete and not (processed <=> manifest)")
    newest = arrivals.groupBy(key).agg(F.max("at").alias("newest"))
    quiet = (F.unix_micros(now) - F.unix_micros("newest")) / 1e6 >= settle
    why = F.when(F.col("photos"), "photos").when(F.col("newest").isNull(), "nothing came").when(quiet, "settled")
    return ready.join(newest, key, "left").withColumn("why", why).filter("why is not null").select(key, "version", "why")


def versions(evidence: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """(key, version, at, items): every arrival makes a version with all items so far; older versions stay."""
    w = W.partitionBy(key).orderBy(at, item)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return evidence.select(key, F.row_number().over(w).alias("version"), at, F.array_join(F.array_sort(F.collect_set(item).over(so_far)), ",").alias("items"))


def claims(jobs: DataFrame, workers: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """(job, worker): each worker (lane, worker) claims one queued job of its lane, and no job is claimed twice.

    Jobs and workers of a lane are numbered in order, and equal numbers meet. No lane's queue is sorted: each task
    keeps as many of a lane's first jobs as the largest lane has workers.
    """
    number = lambda by: F.row_number().over(W.partitionBy(lane).orderBy(*by))
    free = workers.withColumn("_place", number(["worker"]))
    most = workers.groupBy(lane).count().agg(F.max("count")).first()[0] or 0
    queued = jobs.filter("state = 'queued'").withColumn("_place", number(order)).filter(F.col("_place") <= most)
    return queued.join(free, [lane, "_place"]).select("job", "worker")


def recovered(jobs: DataFrame, most: int) -> DataFrame:
    """`jobs` after a restart: those that ran are interrupted once more, and fail at `most`, or wait in the queue again."""
    ran = F.col("state") == "running"
    times = F.col("interruptions") + F.when(ran, 1).otherwise(0)
    return jobs.withColumns({"interruptions": times, "state": F.when(ran & (times >= most), "failed").when(ran, "queued").otherwise(F.col("state"))})


def backoff(failures: Column, first: float, most: float) -> Column:
    """Seconds to wait after so many failures in a row: none, then `first`, doubled each time, `most` at most."""
    return F.when(failures < 1, 0.0).otherwise(F.least(F.lit(most), first * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(60)))))


def overdue(jobs: DataFrame, now: Column, deadlines: dict[str, float]) -> DataFrame:
    """Running jobs (kind, started) past their kind's deadline in seconds; a kind without one is never overdue."""
    limit = F.create_map(*[x for k, v in deadlines.items() for x in (F.lit(k), F.lit(float(v)))])
    ran = (F.unix_micros(now) - F.unix_micros("started")) / 1e6
    return jobs.filter((F.col("state") == "running") & (ran > F.try_element_at(limit, F.col("kind"))))


def swept(rows: DataFrame, now: Column, keep_days: int, remind_days: int) -> DataFrame:
    """`rows` (opened, reminded) with action: delete once `keep_days` have passed, remind once `remind_days` before that, else keep."""
    age = (F.unix_micros(now) - F.unix_micros("opened")) / 86_400e6
    due = (age >= keep_days - remind_days) & (F.col("reminded").isNull() | (F.col("reminded") < F.col("opened")))
    return rows.withColumn("action", F.when(age >= keep_days, "delete").when(due, "remind").otherwise("keep"))


def reserved(requests: DataFrame, key: str, order: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """(key, order, admitted): requests in order, while those admitted are fewer than `most` and fit into `most_bytes`.

    A refused request reserves nothing, so a smaller one after it may be admitted. State is a count and a sum.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def admit(state: list[int], row) -> tuple:
        fits = state[0] < most and state[1] + getattr(row, size) <= most_bytes
        if fits:
            state[:] = [state[0] + 1, state[1] + getattr(row, size)]
        return getattr(row, key), getattr(row, order), fits

    return in_order(requests, key, [order], lambda: [0, 0], admit, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean")


def followed(first: DataFrame, then: DataFrame, key: str, at: str, within: str, watermark: str = "0 seconds") -> DataFrame:
    """Pairs of an event of `first` and one of `then` (key, id, at) of the same key, at most `within` later, or at once.

    Both sides may be streams: with watermarks, Spark drops state that can't match any more.
    """
    marked = lambda df: df.withWatermark(at, watermark) if df.isStreaming else df
    a = marked(first).select(F.col(key).alias("key"), F.col("id").alias("first"), F.col(at).alias("first_at"))
    b = marked(then).select(F.col(key).alias("then_key"), F.col("id").alias("then"), F.col(at).alias("then_at"))
    near = (F.col("key") == F.col("then_key")) & (F.col("then_at") >= F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"interval {within}"))
    return a.join(b, near).select("key", "first", "then", "first_at", "then_at")

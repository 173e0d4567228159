"""Evidence that comes late: every arrival makes a version, a bundle settles once nothing has come for a while.

Arrival times order a key's evidence, whatever the times that the evidence itself tells of, so nothing is too late.
`closures` is the batch form, `closed` the stream's; both give the same rows for the same arrivals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream's state needs: set it before the stream is started.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def closures(evidence: DataFrame, key: str, item: str, arrived: str, settle: float, keep: float, now: str | None = None) -> DataFrame:
    """(key, kind, version, items, at) of evidence (key, item, arrived; a timestamp).

    kind version: an arrival, with all distinct items so far. kind settled: the last version before `settle` seconds
    without an arrival, at their end; up to `now` where it is given. After `keep` seconds without one, versions begin
    anew. Rows without a key or an arrival are left out.
    """
    w = W.partitionBy(key).orderBy(arrived, item)
    micros = F.unix_micros(arrived)
    rows = evidence.filter(F.col(key).isNotNull() & F.col(arrived).isNotNull()).select(key, item, arrived, micros.alias("_t"))
    rows = rows.withColumn("_wait", F.col("_t") - F.lag("_t").over(w)).withColumn("_run", F.sum(F.when(F.col("_wait") >= int(keep * 1e6), 1).otherwise(0)).over(w))
    own = W.partitionBy(key, "_run").orderBy(arrived, item)
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"version": F.row_number().over(own).cast("long"), "items": F.array_join(F.array_sort(F.collect_set(item).over(so_far)), ","), "_next": F.lead("_t").over(w)})
    end = F.coalesce(F.col("_next"), F.unix_micros(F.lit(now).cast("timestamp")) if now else F.lit(None).cast("long"))
    out = lambda kind, at: [key, F.lit(kind).alias("kind"), "version", "items", at.alias("at")]
    settled = rows.filter(end - F.col("_t") >= int(settle * 1e6))
    return rows.select(*out("version", F.col(arrived))).union(settled.select(*out("settled", F.timestamp_micros(F.col("_t") + int(settle * 1e6)))))


class _Bundle(StatefulProcessor):
    """A key's items, its last version and arrival; one timer, for settling first and then for forgetting."""

    def __init__(self, settle: float, keep: float):
        self.settle, self.keep = int(settle * 1e6), int(keep * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.last = handle.getValueState("last", "version long, micros long, settled boolean")

    def _items(self) -> list[str]:
        return sorted(row[0] for row in self.items.get())

    def _row(self, kind: str, version: int, micros: int) -> tuple:
        return kind, version, ",".join(self._items()), pd.Timestamp(micros, unit="us")

    def _frame(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=["kind", "version", "items", "at"])
            frame.insert(0, "key", [key[0]] * len(rows))
            yield frame

    def _set_timer(self, micros: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["arrived", "item"])
        out = []
        for micros, item in zip(new["micros"].tolist(), new["item"].tolist(), strict=True):
            version, last, settled = self.last.get() or (0, None, True)
            if last is not None and not settled and micros - last >= self.settle:
                out.append(self._row("settled", version, last + self.settle))
            if last is not None and micros - last >= self.keep:
                self.items.clear()
                version = 0
            if item is not None and item not in self._items():
                self.items.appendValue((item,))
            self.last.update((version + 1, micros, False))
            out.append(self._row("version", version + 1, micros))
        self._set_timer(self.last.get()[1] + self.settle)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, last, settled = self.last.get()
        out = []
        if not settled:
            out.append(self._row("settled", version, last + self.settle))
            self.last.update((version, last, True))
        if timerValues.getCurrentWatermarkInMs() * 1000 >= last + self.keep:
            self.items.clear()
            self.last.clear()
        else:
            self._set_timer(last + self.keep)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def closed(evidence: DataFrame, key: str, item: str, arrived: str, settle: float, keep: float, delay: str = "0 seconds") -> DataFrame:
    """`closures` of a stream, in append mode; arrivals may be out of order by `delay`. The session needs STATE_STORE.

    Settling and forgetting go by arrival time: a key whose state is forgotten `keep` seconds after its last arrival
    costs nothing any more.
    """
    kind = evidence.schema[key].dataType.simpleString()
    rows = evidence.filter(F.col(key).isNotNull() & F.col(arrived).isNotNull()).select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.col(arrived).alias("arrived"), F.unix_micros(arrived).alias("micros"))
    states = rows.withWatermark("arrived", delay).groupBy("key").transformWithStateInPandas(
        _Bundle(settle, keep), f"key {kind}, kind string, version long, items string, at timestamp", "Append", "EventTime"
    )
    return states.withColumnRenamed("key", key)

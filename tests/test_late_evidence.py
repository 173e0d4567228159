"""Versions of evidence: the stream against the batch form, on arrivals whose own times are shuffled."""

import random
from datetime import datetime, timedelta

from plumbline.streaming import evidence


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    r = random.Random(3)
    for name, value in evidence.STATE_STORE.items():
        spark.conf.set(name, value)
    at, rows = datetime(2024, 1, 1), []
    for i in range(90):
        # Quiet for seconds, for long enough to settle, and for long enough to be forgotten.
        at += timedelta(seconds=r.choice([1, 5, 20, 40, 400]))
        rows.append((r.randrange(3), r.choice(["pose", "mesh", "photo", None]), at, at - timedelta(days=r.randrange(30))))
    # Two at once, of one key.
    rows += [(0, "a", at, at), (0, "b", at, at)]
    schema = "scan long, item string, arrived timestamp, taken timestamp"
    folder = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = evidence.closed(stream, "scan", "item", "arrived", 30.0, 300.0).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i in range(0, len(rows), 31):
            some = rows[i : i + 31]
            r.shuffle(some)
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        # A last arrival of another key moves the watermark beyond all timers.
        spark.createDataFrame([(9, "end", at + timedelta(days=1), at)], schema).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        got = sorted(map(repr, (x for x in spark.table("closed").collect() if x.scan != 9)))
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    batch = evidence.closures(spark.createDataFrame(rows, schema), "scan", "item", "arrived", 30.0, 300.0, now=str(at + timedelta(days=1)))
    assert got == sorted(map(repr, batch.collect()))
    assert sum("settled" in x for x in got) >= 5
    # Only the last key, with an item, its last version and a timer, is remembered.
    assert state <= 4

"""Streams over files, one file a micro-batch, against the same definitions in batch."""

from datetime import datetime

import pytest

from tessera.streaming import orders, windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a streaming definition over batches of rows; returns what each micro-batch put out."""

    def run(batches, schema, define, mode):
        source = str(tmp_path / "in")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = []
        df = define(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, i: out.append([tuple(r) for r in b.collect()])).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        return out

    return run


NEWS = "group_key string, valid_time timestamp, raw_score double"


def test_windows_close_behind_the_watermark(spark, stream):
    first = [("a", datetime(2024, 1, 1, 9), 1.0), ("a", datetime(2024, 1, 1, 23), 0.0), ("b", datetime(2024, 1, 1, 5), -1.0)]
    second = [("a", datetime(2024, 1, 3, 1), 0.5)]
    third = [("a", datetime(2024, 1, 3, 2), 0.5)]
    # The batch after the one that moves the watermark closes the window, so a late row is dropped from the next on.
    late = [("a", datetime(2024, 1, 1, 10), 9.0)]
    out = stream([first, second, third, late], NEWS, windows.windowed_sentiment, "append")
    rows = sorted(r for b in out for r in b)
    batch = sorted(tuple(r) for r in windows.windowed_sentiment(spark.createDataFrame(first + second, NEWS)).where("start < '2024-01-02'").collect())
    assert rows == batch and len(rows) == 2


def test_sessions_merge_across_batches(spark, stream):
    batches = [[("a", datetime(2024, 1, 1, 9, 0), 0.0)], [("a", datetime(2024, 1, 1, 9, 20), 0.0)], [("a", datetime(2024, 1, 2, 9, 0), 0.0)]]
    out = stream(batches, NEWS, lambda e: windows.sessions(e, "group_key"), "append")
    assert [r for b in out for r in b] == [("a", datetime(2024, 1, 1, 9, 0), datetime(2024, 1, 1, 9, 50), 2)]


def test_order_states_are_kept_across_batches(spark, stream):
    kind = "id string, status string, filled_qty double, seq long"
    batches = [
        [("x", "Submitted", None, 1), ("y", "Accepted", None, 1)],
        [("x", "Filled", 5.0, 3), ("x", "PartiallyFilled", 2.0, 2)],
        [("x", "Cancelled", 7.0, 4), ("y", "Unknown", None, 2)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out = stream(batches, kind, orders.order_states, "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    latest = {r[0]: (r[1], r[2]) for b in out for r in b}
    assert latest == {"x": ("Filled", 5.0), "y": ("Accepted", 0.0)}

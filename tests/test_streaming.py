"""Streams: idempotent upserts, late corrections, incidents, staleness."""

import pytest
from pyspark.sql import functions as F

from tallyforge import streaming

SCHEMA = "k int, at int, v string"


def test_upserts_are_idempotent_and_take_corrections(spark, rows, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = streaming.KeyedTable(spark, f"{tmp_path}/t", ["k"], "at", schema)
    assert table.read().count() == 0
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    table.upsert(frame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]), 0)
    table.upsert(frame([(1, 1, "old"), (2, 5, "late"), (3, 1, "n")]), 1)
    want = [(1, 2, "b"), (2, 5, "late"), (3, 1, "n")]
    assert rows(table.read()) == want
    assert not table.upsert(frame([(9, 1, "again")]), 1)  # the batch runs again
    again = streaming.KeyedTable(spark, f"{tmp_path}/t", ["k"], "at", schema)  # after a restart
    assert rows(again.read()) == want and again.upsert(frame([(3, 9, "z")]), 2) and rows(table.read()) == [*want[:2], (3, 9, "z")]
    assert table.upsert(frame([]), 3) and rows(table.read()) == [*want[:2], (3, 9, "z")]


def test_stream_goes_on_where_it_ended(spark, rows, tmp_path):
    add = lambda i: spark.createDataFrame([(i, 1, "a"), (0, i, f"v{i}")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    for i in range(3):
        add(i)
    schema = spark.createDataFrame([], SCHEMA).schema
    table = streaming.KeyedTable(spark, f"{tmp_path}/t", ["k"], "at", schema)
    seen = []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    streaming.run_to_end(streaming.upsert_stream(stream(), table, lambda df: seen.append(df.count())))
    assert rows(table.read().select("k", "at")) == [(0, 2), (1, 1), (2, 1)] and len(seen) == 3
    add(3)
    q = streaming.upsert_stream(stream(), streaming.KeyedTable(spark, f"{tmp_path}/t", ["k"], "at", schema), lambda df: seen.append(df.count()), every="1 second")
    streaming.run_to_end(q)  # a poll loop: only what is new
    assert rows(table.read().select("k", "at")) == [(0, 3), (1, 1), (2, 1), (3, 1)] and len(seen) == 4

    def bad(df):
        raise ValueError("audit")

    add(4)
    with pytest.raises(Exception, match="audit"):
        streaming.run_to_end(streaming.upsert_stream(stream(), table, bad))
    assert table.read().count() == 4  # nothing of a batch that fails its audit


def test_lock(spark, tmp_path):
    with streaming.Lock(spark, str(tmp_path)):
        with pytest.raises(Exception, match="exist"), streaming.Lock(spark, str(tmp_path)):
            pass
    with streaming.Lock(spark, str(tmp_path)) as lock:
        assert lock.taken


def test_incidents(spark, rows, tmp_path):
    schema = "key string, bad boolean, at int"
    spark.createDataFrame([("a", True, 3), ("a", False, 1), ("a", True, 2), ("a", False, 4), ("b", False, 1), ("a", None, 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    q = streaming.incidents(stream, "key", "bad", "at").writeStream.format("memory").queryName("incidents").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    assert rows(spark.table("incidents")) == [("a", "OPEN", 1, 2), ("a", "RESOLVED", 2, 2), ("a", "UPDATE", 2, 2)]
    spark.createDataFrame([("a", True, 5), ("b", True, 6)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b1")
    streaming.run_to_end(q)
    assert ("a", "OPEN", 1, 5) in rows(spark.table("incidents")) and ("b", "OPEN", 1, 6) in rows(spark.table("incidents"))


def test_schedule(spark, rows):
    plan = spark.createDataFrame([("a", 0), ("b", 100_000_000), ("c", 0), ("d", -900_000_000), ("e", None)], "g string, t bigint")
    found = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "g string")
    got = rows(streaming.scheduled(found, plan, "g", "t", 0, 60, 60))
    assert got == [("a", "ACTIVE"), ("b", "WAITING"), ("c", "MISSING"), ("d", "ENDED"), ("e", "UNTIMED"), ("x", "UNPLANNED")]


def test_stale(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:04:00"), ("c", "2024-01-01 00:04:50")], "k string, at string")
    got = {r.k: r.status for r in streaming.stale(df, ["k"], "at", F.lit("2024-01-01 00:07:00").cast("timestamp"), 180, 300).collect()}
    assert got == {"a": "FAIL", "b": "WARN", "c": "OK"}

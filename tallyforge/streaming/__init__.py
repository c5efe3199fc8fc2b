"""Structured Streaming: keyed upserts per micro-batch, deduplication, windows and stateful incidents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.session import materialise
from tallyforge.sources.sinks import Versions, merged, newest


def files_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, oldest first; a single file is a stream of one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(str(target.getParent().toString()))
    return reader.parquet(path)


class KeyedTable:
    """A Parquet table kept by key through micro-batches, in a folder that can be opened again.

    Rows lie in buckets by key. A batch rewrites the buckets it has rows of, as new folders, and then writes the record
    that names every bucket's folder and the batch (`Versions`); readers see the table before the batch or after it. A
    batch whose number is recorded already is passed over, so a batch that runs again changes nothing. The greatest
    `at` of a key wins, so a late correction replaces a row however late it comes, and an older duplicate does not.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at: str, schema, buckets: int = 8):
        self.spark, self.path, self.keys, self.at, self.schema, self.buckets = spark, path.rstrip("/"), keys, at, schema, buckets
        self.versions = Versions(spark, path)

    def _state(self) -> dict:
        last = self.versions.last()
        return last[1] | {"number": last[0]} if last else {"number": -1, "batch": -1, "folders": {}}

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Take in batch `number`; False where it was taken in before."""
        state = self._state()
        if number <= state["batch"]:
            return False
        mine = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = newest(batch.select([f.name for f in self.schema.fields]), self.keys, self.at)
        new = materialise(self.spark, new.withColumn("_bucket", mine), "batch")
        touched = [str(r["_bucket"]) for r in new.select("_bucket").distinct().collect()]  # at most `buckets` rows
        old = [f"{self.path}/{state['folders'][b]}" for b in touched if b in state["folders"]]
        rows = new.drop("_bucket")
        if old:
            before = self.spark.read.schema(self.schema).parquet(*old)
            seen = before.select(*self.keys, F.col(self.at).alias("_seen"))
            rows = rows.join(seen, self.keys, "left").filter(F.col("_seen").isNull() | (F.col(self.at) >= F.col("_seen"))).drop("_seen")
            rows = merged(before, rows, self.keys).select(before.columns)
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", mine).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = state["folders"] | {b: f"{folder}/_bucket={b}" for b in touched}
        self.versions.commit(state["number"] + 1, {"batch": number, "folders": folders})
        self.versions.forget(2, lambda r: list(r["folders"].values()))
        return True

    def read(self) -> DataFrame:
        """The table after the last batch that was taken in."""
        folders = self._state()["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])


def run_to_end(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()


def upsert_stream(stream: DataFrame, table: KeyedTable, check: Callable[[DataFrame], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Feed a stream into a keyed table; `check` may raise on a batch's rows, which then are not taken in.

    The checkpoint lies beside the table, so a stream that is started again goes on where it ended. every: how often
    to look for new rows (a poll loop); without it all that is there is taken in and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        if check:
            check(df)
        table.upsert(df, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{table.path}/_stream")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Lock:
    """One process at a time for a folder: a record that only one can create. Ends with the block or with `release`."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions, self.taken = Versions(spark, f"{path.rstrip('/')}/_lock"), False

    def __enter__(self) -> Lock:
        self.versions.commit(0, {"holder": uuid.uuid4().hex})  # fails where it is there
        self.taken = True
        return self

    def __exit__(self, *_) -> None:
        if self.taken:
            self.release()

    def release(self) -> None:
        """Also for a lock whose holder is gone."""
        self.versions._fs.delete(self.versions._at("_versions"), True)
        self.taken = False


def scheduled(events: DataFrame, schedule: DataFrame, key: str, begins: str, now, ahead: int, behind: int) -> DataFrame:
    """(key, state): events that were discovered against the schedule, both ways.

    ACTIVE from `ahead` seconds before the event's time until `behind` after it, WAITING before, ENDED after; UNPLANNED
    without a row in the schedule, MISSING where the schedule's active event was not discovered, UNTIMED without a time.
    """
    at = F.unix_micros(now) if not isinstance(now, int) else F.lit(now)
    found = events.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_found", F.lit(True))
    plan = schedule.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(begins).alias("_at"), F.lit(True).alias("_planned"))
    both = found.join(plan, key, "full_outer")
    begun = (F.col("_at") - ahead * 1_000_000 <= at) & (at <= F.col("_at") + behind * 1_000_000)
    state = F.when(F.col("_planned").isNull(), "UNPLANNED").when(F.col("_at").isNull(), "UNTIMED").when(begun, F.when(F.col("_found"), "ACTIVE").otherwise("MISSING")).when(at < F.col("_at"), "WAITING").otherwise("ENDED")
    return both.select(key, state.alias("state"))


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; a copy later than `delay` after it may pass, which bounds the state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, at: str, length: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Counts and sums per time window; with a watermark if the input is a stream."""
    df = df.withWatermark(at, delay) if delay else df
    return df.groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, at: str, length: str, step: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.window(at, length, step), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions: rows of a key with less than `gap` between them."""
    return df.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def stale(df: DataFrame, keys: list[str], at: str, now, warn: int, fail: int) -> DataFrame:
    """(keys, age_seconds, status) from the newest row of each key: OK, WARN from `warn` seconds, FAIL from `fail`."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max(at).cast("timestamp"))
    out = df.groupBy(*keys).agg(age.alias("age_seconds"))
    return out.withColumn("status", F.when(F.col("age_seconds") >= fail, "FAIL").when(F.col("age_seconds") >= warn, "WARN").otherwise("OK"))


def incidents(stream: DataFrame, key: str, bad: str, at: str) -> DataFrame:
    """(key, state, n, opened): OPEN when a key turns bad, UPDATE while it stays so, RESOLVED when it is good again.

    n counts bad reports of the incident, opened is when it began. Reports of one batch are taken in the order of their
    times, good before bad at equal ones, whatever the chunks they come in; reports without a time come first, those
    without a state say nothing.
    """

    def step(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, opened = state.get if state.exists else (0, None)
        reports = pd.concat([p[[at, bad]] for p in pdfs]).dropna(subset=[bad]).sort_values([at, bad], na_position="first")
        out = []
        for when, wrong in zip(reports[at].tolist(), reports[bad].tolist()):
            if wrong:
                n, opened = n + 1, when if n == 0 else opened
                out.append((k[0], "OPEN" if n == 1 else "UPDATE", n, opened))
            elif n:
                out.append((k[0], "RESOLVED", n, opened))
                n, opened = 0, None
        state.update((n, opened))
        yield pd.DataFrame(out, columns=["key", "state", "n", "opened"])

    kind = "bigint"
    rows = stream.select(F.col(key).cast("string").alias(key), F.col(bad).cast("boolean").alias(bad), F.col(at).cast(kind).alias(at))
    return rows.groupBy(key).applyInPandasWithState(step, f"key string, state string, n int, opened {kind}", f"n int, opened {kind}", "append", "NoTimeout")

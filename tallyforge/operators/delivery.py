"""Messages delivered more than once: sorted runs in hash-bucketed storage, merged by compaction."""

from __future__ import annotations

import atexit
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros
from tallyforge.session import scratch_path, width
from tallyforge.sources.sinks import Versions

LAST = 2**62  # sorts deliveries without a time behind all others


class SortedRunStore:
    """Hash-bucketed, sorted storage of deliveries under an identifier, in a folder that can be opened again.

    `upsert` appends sorted runs: one file per bucket. Rows are bucketed by identifier, content and slice, a hash of
    the delivery, so a message that makes up a third of all rows is spread over as many buckets as the session has
    shuffle partitions. Upserts are idempotent: a batch that comes twice gives equal rows, and equal rows are one
    delivery. `compact` merges all runs into one: per identifier and content the earliest delivery stays (at a tie
    the smallest id), first within buckets, without a shuffle, then over the slices' survivors. The merged run
    takes the place of the others with the record of a new generation; the ids of dropped deliveries are kept.

    Columns: ident (never NULL), digest (content hash or NULL), body (fingerprint of the content or NULL),
    seen (microseconds or NULL, NULL last), delivery (unique id), batch (which batch brought it).
    """

    COLUMNS = "ident string, digest string, body binary, seen bigint, delivery bigint, batch string"
    KEYS = ("ident", "digest", "body", "slice")

    def __init__(self, spark: SparkSession, path: str | None = None, slices: int | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "runs")
        self.versions = Versions(spark, self.path)
        last = self.versions.last()
        if last is None:
            record = {"folder": f"runs-{uuid.uuid4().hex}", "dropped": [], "slices": slices or max(8, width(spark)), "buckets": buckets or max(8, width(spark))}
            self.versions.commit(0, record)
            last = 0, record
        self._use(*last)

    def _use(self, number: int, record: dict) -> None:
        self.number, self.record = number, record
        location = f"{self.path}/{record['folder']}"
        self.table = f"sorted_runs_{hashlib.sha256(location.encode()).hexdigest()[:32]}"
        keys = ", ".join(self.KEYS)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS}, slice int) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, seen, delivery) INTO {record['buckets']} BUCKETS LOCATION '{location}'")
        atexit.register(self._drop, self.table)

    def _drop(self, table: str) -> None:
        """Forget the table; its files stay, as they are the folder's."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone already
            pass

    def _append(self, rows: DataFrame, table: str) -> None:
        """Write rows that are partitioned as the table's buckets are: each task writes the one file of its bucket."""
        n = self.record["buckets"]
        rows.write.format("parquet").bucketBy(n, *self.KEYS).sortBy(*self.KEYS, "seen", "delivery").mode("append").saveAsTable(table)

    def upsert(self, batch: DataFrame) -> SortedRunStore:
        """Append rows (COLUMNS) of one batch or several as sorted runs."""
        columns = [c.split()[0] for c in self.COLUMNS.split(", ")]
        rows = batch.select(*columns, F.pmod(F.xxhash64("delivery"), F.lit(self.record["slices"])).cast("int").alias("slice"))
        self._append(rows.repartition(self.record["buckets"], *self.KEYS), self.table)
        return self

    def runs(self) -> DataFrame:
        return self.spark.table(self.table)

    def compact(self) -> SortedRunStore:
        """Merge all runs into one. A compaction that breaks off leaves the runs as they were."""
        first = F.min(F.struct(F.coalesce("seen", F.lit(LAST)).alias("at"), "delivery", "batch")).alias("first")
        heads = self.runs().groupBy(*self.KEYS).agg(first)
        # the slices' survivors of a content meet; a merged run has slice 0
        # (slices are 0 or more; a literal would leave the grouping, and rows would be shuffled once more)
        heads = heads.withColumn("slice", F.least("slice", F.lit(0))).repartition(self.record["buckets"], *self.KEYS)
        one = heads.groupBy(*self.KEYS).agg(F.min("first").alias("first"))
        record = self.record | {"folder": f"runs-{uuid.uuid4().hex}", "dropped": [*self.record["dropped"], f"dropped-{uuid.uuid4().hex}"]}
        old, before = self.table, self.runs()
        number = self.number
        self._use(number, record)
        rows = one.select("ident", "digest", "body", F.when(F.col("first.at") != LAST, F.col("first.at")).alias("seen"), "first.delivery", "first.batch", "slice")
        self._append(rows, self.table)
        gone = before.select("delivery").distinct().join(self.runs().select("delivery"), "delivery", "left_anti")
        gone.write.parquet(f"{self.path}/{record['dropped'][-1]}")
        self.versions.commit(number + 1, record)
        self.number = number + 1
        self.versions.forget(1, lambda r: [r["folder"], *r["dropped"]])
        self._drop(old)
        return self

    def dropped(self) -> DataFrame:
        """(delivery): those that are copies of one that stays, over all that was compacted.

        Contents that differ in form may still be one: a missing hash is that of a row of the same identifier with
        the same values, else the values count. So the merged run has a row for each form, and of those of one content
        the earliest stays.
        """
        forms = self.runs()
        bodies = forms.filter("digest is not null and body is not null").groupBy("ident", "body").agg(F.min("digest").alias("_known"))
        hashed, bare, plain = forms.filter("digest is not null"), forms.filter("digest is null and body is not null").join(bodies, ["ident", "body"], "left"), forms.filter("digest is null and body is null")
        content = lambda df, c: df.select("ident", c.alias("content"), "seen", "delivery")
        marked = lambda c: F.concat(F.lit("d"), c)
        each = content(hashed, marked(F.col("digest"))).unionByName(content(bare, F.coalesce(marked(F.col("_known")), F.concat(F.lit("b"), F.hex("body"))))).unionByName(content(plain, F.lit("")))
        best = each.groupBy("ident", "content").agg(F.min(F.struct(F.coalesce("seen", F.lit(LAST)).alias("at"), "delivery"))["delivery"].alias("delivery"))
        out = each.select("delivery").join(best.select("delivery"), "delivery", "left_anti")
        if self.record["dropped"]:
            out = out.unionByName(self.spark.read.schema("delivery bigint").parquet(*[f"{self.path}/{x}" for x in self.record["dropped"]]))
        return out.distinct()


def body_fingerprint(raw) -> F.Column:
    """SHA-256 of a JSON object's values by name, whatever the order of names and the blanks between them.

    Missing and null values are the same; text that is no JSON object counts as it stands, trimmed.
    """
    fields = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    entries = F.array_sort(F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull()))
    return F.when(raw.isNotNull(), F.sha2(F.coalesce(F.when(F.size(entries) > 0, F.to_json(entries)), F.trim(raw)), 256))


def deliveries(capture: DataFrame) -> DataFrame:
    """source_capture as rows for the store. Rows without an identifier (NULL or blank) are left out."""
    ident = F.lower(F.regexp_replace("source_event_id", r"^\s+|\s+$", ""))
    digest = F.lower(F.trim("content_hash"))
    return capture.select(
        ident.alias("ident"),
        F.when(digest != "", digest).alias("digest"),
        F.unhex(body_fingerprint(F.col("raw_feed_fields"))).alias("body"),
        iso_micros(F.col("first_seen_at_utc")).alias("seen"),
        F.col("capture_id").cast("long").alias("delivery"),
        F.col("batch_id").cast("string").alias("batch"),
    ).filter("ident is not null and ident != ''")


def dropped_deliveries(capture: DataFrame, path: str | None = None) -> DataFrame:
    """capture_id of each delivery that is a copy of one that stays.

    Two rows are copies if the identifier is the same (letter case and blanks around it aside) and so is the
    content: the hash, or where a hash is missing the values in raw_feed_fields. The earliest first_seen_at_utc
    stays, at a tie the smallest capture_id; a missing or unusable time is later than any other. Rows with
    neither hash nor values are copies of each other under one identifier. An empty table gives no rows.

    The table goes into the store (in `path`, or a new one) as it came, in an earlier and a later part, and is
    compacted after each, so that what the first compaction kept meets what came after it.
    """
    store, middle = SortedRunStore(capture.sparkSession, path), capture.agg(F.percentile_approx("capture_id", 0.5)).first()[0]
    late = F.coalesce(F.col("capture_id") > F.lit(middle), F.lit(True))
    for part in (capture.filter(~late), capture.filter(late)):
        store.upsert(deliveries(part)).compact()
    return store.dropped().select(F.col("delivery").alias("capture_id"))

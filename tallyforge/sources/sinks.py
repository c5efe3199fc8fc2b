"""Writers: every write goes to a new folder or partition first, so a failed job leaves the old table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Upsert: rows of `new` replace those of `old` with the same key; columns in keep_old keep old values over NULLs.

    One full join on the key. `new` is to have a key once; see `newest`. NULL keys match nothing and are kept.
    """
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_o"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in rest]).alias("_n"))
    pick = lambda c: F.coalesce(f"_n.{c}", f"_o.{c}") if c in keep_old else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return o.join(n, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in rest])


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key: the one with the greatest `at`, then the greatest other values."""
    rest = [c for c in df.columns if c not in (*keys, at)]
    best = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (at, *rest)]).select(df.columns)


def only_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of `new` whose key is not in `old`, one per key."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
    return once.join(old.select(*keys), keys, "left_anti").select(new.columns)


class Versions:
    """Numbered versions of something in a folder: small records, each written once and never changed.

    A version counts from the moment its record is there, and a record is created only where none has its number, so
    readers see one version or the next, writers cannot take each other's place, and nothing is renamed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        folder = self._at("_versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def record(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"_versions/{number:010d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict] | None:
        """Number and record of the current version; None before the first."""
        for number in reversed(self.numbers()):
            return number, self.record(number)
        return None

    def commit(self, number: int, record: dict) -> None:
        """Make `record` version `number`; an error where that number is taken."""
        out = self._fs.create(self._at(f"_versions/{number:010d}"), False)
        out.write(json.dumps(record).encode())
        out.close()

    def forget(self, keep: int, folders) -> None:
        """Remove all but the last `keep` records, and the data folders that only those name (`folders` of a record)."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        used = {f for n in kept for f in folders(self.record(n))}
        for n in old:
            for f in set(folders(self.record(n))) - used:
                self._fs.delete(self._at(f), True)
            self._fs.delete(self._at(f"_versions/{n:010d}"), False)


def publish(df: DataFrame, path: str, partition_by: list[str] = (), keep: int = 2) -> int:
    """Replace a whole table: a new folder, then its record (`Versions`); `published` reads it. The version's number.

    A failed write leaves the old table. The last `keep` versions stay, so that a reader who has begun can end.
    """
    versions = Versions(df.sparkSession, path)
    last = versions.last()
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{versions.path}/{folder}")
    number = last[0] + 1 if last else 0
    versions.commit(number, {"folder": folder, "schema": df.schema.jsonValue()})
    versions.forget(keep, lambda r: [r["folder"]])
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table that was published last."""
    last = Versions(spark, path).last()
    if last is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return spark.read.schema(StructType.fromJson(last[1]["schema"])).parquet(f"{path.rstrip('/')}/{last[1]['folder']}")


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def mirror(df: DataFrame, path: str) -> tuple[int, int]:
    """Write Parquet and CSV of the same rows; returns both row counts, read again."""
    spark = df.sparkSession
    publish(df, f"{path}/parquet")
    saved = published(spark, f"{path}/parquet")
    saved.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return saved.count(), spark.read.schema(saved.schema).option("header", True).csv(f"{path}/csv").count()


class Artifacts:
    """Tables under the hash of their content: what is there is never written again or changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, df: DataFrame) -> tuple[str, bool]:
        """(digest, whether it was new) of df's rows, whatever their order."""
        from tallyforge.operators.audit import table_fingerprint

        digest = table_fingerprint(df, sorted(df.columns)).first()["digest"]
        new = Versions(self.spark, f"{self.path}/{digest}").last() is None
        if new:
            publish(df, f"{self.path}/{digest}")
        return digest, new

    def get(self, digest: str) -> DataFrame:
        return published(self.spark, f"{self.path}/{digest}")


class Ledger:
    """Append-only snapshots in Parquet, partitioned by snapshot; a payload that is there already is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _headers(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/headers")
        except AnalysisException:
            return self.spark.createDataFrame([], "snapshot_id string, payload string, captured_at string, n_rows bigint")

    def append(self, snapshot_id: str, captured_at: str, rows: DataFrame) -> bool:
        """False if the same rows or the snapshot were captured before; the header is written last."""
        from tallyforge.operators.audit import table_fingerprint

        mark = table_fingerprint(rows, sorted(rows.columns)).first()
        if self._headers().filter((F.col("payload") == mark["digest"]) | (F.col("snapshot_id") == snapshot_id)).limit(1).count():
            return False
        rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.path}/rows")
        header = [(snapshot_id, mark["digest"], captured_at, mark["n_rows"])]
        self.spark.createDataFrame(header, "snapshot_id string, payload string, captured_at string, n_rows bigint").write.mode("append").parquet(f"{self.path}/headers")
        return True

    def rows(self) -> DataFrame:
        """Rows of snapshots whose header was written."""
        return self.spark.read.parquet(f"{self.path}/rows").join(self._headers().select("snapshot_id"), "snapshot_id", "left_semi")


def revisions(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df with `revision`, 1 for a key's first row by time."""
    return df.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(at)))

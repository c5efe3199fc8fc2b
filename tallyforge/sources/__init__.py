"""Readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parquet_or_csv(spark: SparkSession, parquet: str, csv: str, schema: str, columns: list[str]) -> DataFrame:
    """The Parquet table if its path exists, else the CSV file, else an error; only `columns` are read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(parquet).select(*columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return csv_table(spark, csv, schema).select(*columns)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; fields that do not fit are NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def discovered_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, modified, length) of a folder's files that fit a pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def resolved_columns(df: DataFrame, wanted: dict[str, list[str]], optional: dict[str, float] | None = None) -> DataFrame:
    """df with canonical names: the first candidate that exists (case aside), a default for optional ones, else an error."""
    have = {c.lower(): c for c in df.columns}
    out: list[Column] = []
    for name, candidates in wanted.items():
        found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        if found:
            out.append(F.col(found).alias(name))
        elif optional and name in optional:
            out.append(F.lit(optional[name]).alias(name))
        else:
            raise ValueError(f"no column for {name} among {df.columns}")
    return df.select(*out)


def rss_items(df: DataFrame, xml: str) -> DataFrame:
    """(guid, title, pub_date, link) of the items in a column of RSS documents, a row per item."""
    item = "struct<guid:string,title:string,pubDate:string,link:string>"
    parsed = F.from_xml(F.col(xml), f"struct<channel:struct<item:array<{item}>>>")
    rows = df.select(F.explode(parsed["channel"]["item"]).alias("i"))
    return rows.select(F.col("i.guid").alias("guid"), F.col("i.title").alias("title"), F.col("i.pubDate").alias("pub_date"), F.col("i.link").alias("link"))


def html_fields(df: DataFrame, keep: list[str], html: str, pattern: str, names: list[str]) -> DataFrame:
    """A row for each match of `pattern` in a text column, its groups as columns."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), i + 1) for i in range(len(names))]
    return df.select(*keep, F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])).alias("m")).select(*keep, *[F.col(f"m.{n}").alias(n) for n in names])


class JsonPages(DataSource):
    """`spark.read.format("json_pages")`: JSON documents fetched over HTTP, one partition per URL.

    Options: urls (separated by blanks), timeout (seconds), retries. Rows: url, status, bytes, body; a failed fetch is
    a row with its status or NULL, so that one source cannot fail the batch.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "url string, status int, bytes bigint, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.timeout, self.retries = float(options.get("timeout", 20)), int(options.get("retries", 2))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        import time
        import urllib.error
        import urllib.request

        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(partition.value, timeout=self.timeout) as answer:
                    body = answer.read()
                    yield partition.value, int(getattr(answer, "status", None) or 200), len(body), body.decode("utf-8", "replace")
                    return
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == self.retries:
                    yield partition.value, e.code, 0, None
                    return
            except (OSError, ValueError):
                if attempt == self.retries:
                    yield partition.value, None, 0, None
                    return
            time.sleep(min(2**attempt, 10))

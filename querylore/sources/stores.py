"""Writers, and readers for what they wrote."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from querylore.sources.folders import LIST, folder_names, open_file, put_file, read_files, write_files

BROKEN = "_broken"


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object per row; nested columns stay nested."""
    df.write.mode("overwrite").json(path)
    return path


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    wanted = StructType(list(schema.fields)).add(BROKEN, StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    return spark.read.text(path).filter("value <> ''").select(F.from_json("value", wanted, options).alias("row"))


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON objects of a known schema, one per line. Broken lines do not stop the run; ``broken_json`` has them."""
    return _parsed(spark, path, schema).filter(F.col(f"row.{BROKEN}").isNull()).select("row.*").drop(BROKEN)


def broken_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that could not be read, for a warning."""
    return _parsed(spark, path, schema).filter(F.col(f"row.{BROKEN}").isNotNull()).select(F.col(f"row.{BROKEN}").alias("line"))


def analysis_path(source: str) -> str:
    """Where the analysis of a query file goes unless told otherwise."""
    head, dot, _ = source.rpartition(".")
    return f"{head if dot and '/' not in _ else source}_analysis.json"


def write_pages(pages: DataFrame, folder: str) -> str:
    """Rows (path, content) as one file each, of that path below the folder. Contents are written by the executors that made them, and all
    pages appear at once. Paths must be distinct."""
    return write_files(pages.select(F.col("path").alias("name"), "content"), folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the pages of a folder."""
    return read_files(spark, folder).select(F.col("name").alias("path"), F.decode("content", "UTF-8").alias("content"))


def append_rows(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path


def updated_rows(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with those of the same key replaced, and new ones added. Write the result to a new folder: a folder
    cannot be overwritten while it is read."""
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


BUCKETS = 64
_BUCKET = "bucket"


class KeyedTable:
    """A table whose rows are replaced by key, stored in hash buckets of the key, each in a folder of the version that wrote it.

    A small list says which version of each bucket is current. An update reads and writes the buckets that its keys fall into, as folders of
    a new version, and then replaces the list by one rename: files of other buckets stay as they are, readers see the table before or after, and a killed update leaves
    nothing but a folder nobody reads. Superseded folders stay for readers at work. One update at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        with open_file(f"{self.path}/{LIST}") as file:
            known = json.loads(file.read())
        self.keys, self.buckets, self.versions = known["keys"], known["buckets"], {int(b): v for b, v in known["versions"].items()}
        self.schema = StructType.fromJson(known["schema"])
        self.applied = known.get("applied", -1)

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """Stores ``df``, whose keys are unique. A bucket is written by one task, so their number grows with the table."""
        put_file(f"{path.rstrip('/')}/{LIST}", json.dumps({"keys": keys, "buckets": buckets, "versions": {}, "schema": df.schema.jsonValue()}).encode())
        table = cls(df.sparkSession, path)
        table._write(df)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """The table at a path, a new one without rows where there is none."""
        try:
            return cls(spark, path)
        except FileNotFoundError:
            put_file(f"{path.rstrip('/')}/{LIST}", json.dumps({"keys": keys, "buckets": buckets, "versions": {}, "schema": schema.jsonValue()}).encode())
            return cls(spark, path)

    def _put_list(self) -> None:
        known = {"keys": self.keys, "buckets": self.buckets, "versions": self.versions, "schema": self.schema.jsonValue(), "applied": self.applied}
        put_file(f"{self.path}/{LIST}", json.dumps(known).encode())

    def _numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        self._numbered(df).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{version}")
        written = [int(name.split("=")[1]) for name in folder_names(f"{self.path}/{version}") if name.startswith(f"{_BUCKET}=")]  # a name a bucket at most
        self.versions |= dict.fromkeys(written, version)
        self._put_list()

    def _read(self, buckets) -> DataFrame:
        paths = [f"{self.path}/{self.versions[b]}/{_BUCKET}={b}" for b in sorted(buckets) if b in self.versions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.versions)

    def update(self, changes: DataFrame) -> list[int]:
        """Replaces the rows of the changes' keys and adds new ones; the changes' keys are unique. Returns the buckets that were written."""
        changes = changes.select(*self.schema.names)
        touched = sorted(r[0] for r in self._numbered(changes).select(_BUCKET).distinct().collect())  # numbers below ``buckets``
        if touched:
            self._write(updated_rows(self._read(touched), changes, self.keys))
        return touched

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame], DataFrame], number: int | None = None) -> list[int]:
        """Puts mergeable rows together: ``combine`` makes one row a key of stored and new rows, null keys included. Returns the buckets that
        were written. A batch with a ``number`` is merged once: its number is kept in the list that makes it visible, so a batch that a stream
        runs again after a failure, or any number not above the last, changes nothing."""
        if number is not None and number <= self.applied:
            return []
        changes = changes.select(*self.schema.names)
        touched = sorted(r[0] for r in self._numbered(changes).select(_BUCKET).distinct().collect())  # numbers below ``buckets``
        before = self.applied
        self.applied = before if number is None else number
        try:
            if touched:
                self._write(combine(self._read(touched).unionByName(changes)).select(*self.schema.names))
            elif number is not None:
                self._put_list()
        except BaseException:
            self.applied = before
            raise
        return touched

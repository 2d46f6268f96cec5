"""Lazy access to the supplied parquet tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylore.session import spread
from querylore.sources.views import BASE_TABLES, VIEWS, needed_views, spark_text

# views whose texts are read word by word or that make many rows of one, and the table their rows come from
SPREAD = {"query_log": "events", "kb_chunk": "documents"} | {f"cat_{x}": "customer" for x in ("table", "column", "key", "index")}


class Tables:
    """``tables.orders`` is the parquet table, ``tables.db_order`` the view built from it."""

    _open: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Tables":
        """One instance per application and folder, so that file footers are read once."""
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                self._frames[name] = self.sql(spark_text(name), SPREAD.get(name))
            else:
                raise AttributeError(f"no table or view named {name}")
        return self._frames[name]

    def sql(self, text: str, heavy: str | None = None) -> DataFrame:
        """Run Spark SQL over these tables and views; ``heavy`` names a table to deal to all cores."""
        for name in needed_views(text):
            frame = getattr(self, name)
            (spread(frame) if name == heavy else frame).createOrReplaceTempView(name)
        return self.spark.sql(text)

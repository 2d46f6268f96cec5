"""Reading catalogs and tables of a relational database through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Address forms and driver classes by kind of database.
ADDRESSES = {"postgresql": "jdbc:postgresql://{host}:{port}/{name}", "mysql": "jdbc:mysql://{host}:{port}/{name}"}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def connection_options(host: str, port: int, name: str, user: str, password: str, schema: str | None = None, kind: str = "postgresql") -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``. The schema becomes the search path, in MySQL the database."""
    if kind not in ADDRESSES:
        raise ValueError(f"unknown kind of database: {kind}")
    database = schema if kind == "mysql" and schema else name
    options = {"url": ADDRESSES[kind].format(host=host, port=port, name=database), "user": user, "password": password, "driver": DRIVERS[kind]}
    if schema and kind == "postgresql":
        options["sessionInitStatement"] = f'SET search_path TO "{schema}"'
    return options


def read_query(spark: SparkSession, options: dict[str, str], sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", sql).load()


def read_table(spark: SparkSession, options: dict[str, str], table: str, split: str, low: int, high: int, parts: int) -> DataFrame:
    """A large table in parts by ranges of a numeric column, so that no task reads it whole."""
    return (
        spark.read.format("jdbc").options(**options).option("dbtable", table).option("partitionColumn", split)
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    )

"""The driver's tables, and how a module collects its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of one folder by name: ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' timestamps have no zone
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(function: Callable[[Tables], DataFrame]) -> Callable:
            queries[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
            if text is not None:
                sql[function.__name__] = text
            return function

        return add

    return queries, sql, query

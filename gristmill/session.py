"""Sessions and tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "gristmill", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution on and times in UTC; anything in ``conf`` wins.  An existing session is used as it is."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    return builder.config(map=base | conf).getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt out over all cores if its files give fewer tasks than there are; one of many files is left alone."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table

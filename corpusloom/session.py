"""Sessions and table access shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "corpusloom") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

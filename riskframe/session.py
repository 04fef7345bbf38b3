"""Session builder for scripts and tests.  Library functions take any session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    name: str = "riskframe", master: str = "local[8]", shuffle_partitions: int | None = 8, **settings
) -> SparkSession:
    """A session with the settings the plans rely on.

    On a cluster leave ``shuffle_partitions`` at ``None`` and let AQE size them.
    """
    builder = (
        SparkSession.builder.appName(name)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

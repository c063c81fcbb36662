"""Session settings that every query of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable across engines; AQE re-plans partition counts and skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the session that the cluster made instead."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | extra
    spark = SparkSession.builder.master(master).appName("daybook").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

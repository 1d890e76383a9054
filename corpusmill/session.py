"""SparkSession factory with the settings every corpusmill job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stages that call outside services must not run twice.
    "spark.speculation": "false",
}


def get_session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments add settings, underscores standing for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""A session with the settings that the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """AQE re-plans joins and skew at run time; times are UTC. On a cluster, `master` and sizes come from spark-submit."""
    builder = SparkSession.builder.appName("quarry").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master or not os.environ.get("MASTER"):
        builder = builder.master(master or "local[*]")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

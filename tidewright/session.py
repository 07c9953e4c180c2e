"""A session with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tidewright", master: str | None = None, **conf) -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(name).master(master or f"local[{cores}]")
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cores, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

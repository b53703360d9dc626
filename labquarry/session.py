"""Session settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def session(app: str = "labquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. What spark-submit or spark-defaults have set stays; conf wins over it."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # a submitted job: its JVM is there and knows the settings
        SparkContext._ensure_initialized()
    given = SparkConf()
    defaults = {
        "spark.master": "local[8]",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    if (master or given.get("spark.master", "local")).startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = "8"  # a cluster keeps its own number
    b = SparkSession.builder.appName(app)
    for k, v in ({k: v for k, v in defaults.items() if not given.contains(k)} | ({"spark.master": master} if master else {}) | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()

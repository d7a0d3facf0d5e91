"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def session(app: str = "tessella", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; more settings as spark_sql_x="..." style pairs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (conf | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def use_shared_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder all executors share: the one the session names; a local one only where all runs on this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints/tessella")

"""The session that queries are written for: UTC, ANSI mode, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "docengine", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()

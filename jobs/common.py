"""What both jobs share: their config files, their log, and a session for the command line."""

from __future__ import annotations

import json
import logging
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(name: str, path: str | None = None) -> dict[str, Any]:
    """The settings of a job: those beside its module, and over them those of the file at path."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        settings = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        unknown = sorted(set(given) - set(settings))
        if unknown:
            raise ValueError(f"settings that the job does not have: {unknown}")
        settings |= given
    return settings


def session(app: str) -> SparkSession:
    """For command lines: the session that spark-submit sets up, or a local one."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if "SPARK_ENV_LOADED" not in os.environ and "MASTER" not in os.environ:
        builder = builder.config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def put(df: DataFrame, path: str, *by: str, replace: str = "dynamic") -> None:
    """Write df by the columns `by`: dynamic replaces only the partitions that df has, static the whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(*by).parquet(path)
    log.info("wrote %s by %s", path, ", ".join(by))

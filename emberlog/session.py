"""A Spark session with the settings that this library expects."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, name: str = "emberlog", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share; a temporary one only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="emberlog-"))
    path = f"{found.rstrip('/')}/emberlog-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has already ended
            return

"""Folders for tables that live no longer than a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; where that is unset, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.gettempdir()).removeprefix('file://').rstrip('/')}/sparklog-{uuid.uuid4().hex}"

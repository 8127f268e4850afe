"""Folders for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; a temporary one where that is unset and the master is
    local (tests).
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="flowloom-")
    return f"{top.rstrip('/')}/flowloom-{uuid.uuid4().hex}"

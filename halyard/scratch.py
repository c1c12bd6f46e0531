"""Scratch paths on the file system that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent a folder is made and registered, and only
    in local mode: executors elsewhere would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="halyard-"))
            made = spark.sparkContext.getCheckpointDir()
        root = made
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/halyard-{name}-{uuid.uuid4().hex}"

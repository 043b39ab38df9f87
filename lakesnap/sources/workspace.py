"""Folders for intermediate tables, in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. A session on one machine that has none gets a new local folder; on a
    cluster, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lakesnap-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/lakesnap/{uuid.uuid4().hex}"

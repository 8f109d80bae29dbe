"""Where streams, written tables and files that tasks read are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which must be set on a cluster; below a local one only under a local master without it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not found.isDefined() and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"

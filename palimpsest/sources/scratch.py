"""The folder for intermediate tables, which all executors and the driver must reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Where the folder of a single-machine session is remembered.
OWN = "palimpsest.scratch"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder given to ``setCheckpointDir``.

    Only a session that runs in one process may make a folder of its own; on a
    cluster each machine would see another one, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get(OWN, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(OWN, root)
    return root.rstrip("/")

"""Reliable checkpoints in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(rows: DataFrame) -> DataFrame:
    """Compute ``rows`` once and keep them in the session's ``spark.checkpoint.dir``.

    Every executor must reach that folder. Without one this fails: a local folder would hold
    a part of the rows on each machine.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured)
    return rows.checkpoint()

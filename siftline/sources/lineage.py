"""Tables that grow with the input: cutting the lineage of those that rounds build on, in the folder that all machines share, and keeping them off the driver."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df``, whose joins are to be shuffled and merged at every size.

    The planner reckons what comes of compressed files, exploded arrays and checkpoints at a small part of its size, and would gather it on the driver to broadcast it.
    """
    return df.hint("merge")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores by a hash of themselves.

    A table of small rows is read by as many tasks as its compressed bytes ask for, a handful for millions of rows, and so would be all that is worked out of each row.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def kept(df: DataFrame) -> DataFrame:
    """``df``, written once to ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder, a cluster an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)

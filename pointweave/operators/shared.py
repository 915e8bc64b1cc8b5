"""Plumbing shared by the operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset a local session gets a folder of
    its own; a cluster must name one."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if to is not None:
        return to
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join("/tmp", f"shared-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder. A checkpoint keeps its plan's estimate of size, which is of no use here: from
    a compressed file it can lie far below what the rows take, and the planner then sends a large table through the
    driver to all tasks (a broadcast join); and joins multiply estimates, in a loop until the driver only multiplies.
    Without one, only tables that turn out small in a shuffle are sent."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def dealt(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: the rows are shuffled, whatever the planner makes of its size."""
    return df.hint("merge")

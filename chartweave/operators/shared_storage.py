"""Tables written to the shared folder to cut lineage or to be read twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; every executor can reach it.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="chartweave-")


def write_through(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Its rows, and anything non-deterministic in them, are fixed from here on,
    and readers of a few columns do not pay for the others.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/chartweave/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

"""Session helpers: reading tables and cutting lineage safely."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a directory of them)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which executors must share; where it is unset, a
    cluster raises an error, and local mode (tests, a laptop) takes a folder that ends with the process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut, in Parquet files of the same folder: compressed, where a checkpoint holds plain rows, and read by column.

    Nothing removes the files before the folder is removed.
    """
    path = f"{_checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

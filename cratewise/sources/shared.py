"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only where one machine is all there is."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or _own_folder()


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Columns compress well, so a file of few megabytes may hold millions of rows, and a broadcast takes them
    all through the driver."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again: what several joins need is worked out once, and a lost executor repeats nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

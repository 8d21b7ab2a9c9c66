"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A temporary one only in local mode, where one machine is all there is; on a cluster without either, an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", context.master):
        return f"file://{_own_folder()}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor repeats nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables. What was written from them since stays whole."""
    for table in tables:
        spark = table.sparkSession
        folder = shared_folder(spark)
        for parent in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if folder.split(":", 1)[-1].strip("/") in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one (``row``), so that no helper column can clash with one of them; the text goes along once."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, a null text as an empty one; other columns can't clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def row_key() -> Column:
    """Tells rows apart: repeated ids with other texts differ, wholly equal rows don't."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"), F.length("text").alias("n"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text (a null one: empty), modulo ``parts``."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has so few rows, and left to a shuffled join beyond that."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label: one row an id, the highest label where ids repeat; null ids or labels aren't used."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the last one its constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - ridge * w)
    return w

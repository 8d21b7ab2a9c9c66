"""Incremental intake: only new or changed files are processed, in batches or as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cratewise.operators.tracks import clean_frames, high_quality
from cratewise.sources.files import append_ledger, latest, read_ledger
from cratewise.sources.shared import by_shuffle


def fresh(tracks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tracks that the ledger doesn't have, or has with an older time."""
    seen = by_shuffle(latest(ledger).select("path", F.col("mtime").alias("seen")))
    return tracks.join(seen, (tracks["path"] == seen["path"]) & (tracks["mtime"] <= seen["seen"]), "left_anti")


def skipped(tracks: DataFrame, ledger: DataFrame) -> DataFrame:
    seen = by_shuffle(latest(ledger).select("path", F.col("mtime").alias("seen")))
    return tracks.join(seen, (tracks["path"] == seen["path"]) & (tracks["mtime"] <= seen["seen"]), "left_semi")


def start(frames: DataFrame, out: str, checkpoint: str, inventory: DataFrame | None = None, ledger: str | None = None) -> StreamingQuery:
    """A stream of tag frames to a change log; a batch that is delivered again replaces its own folder.

    With an ``inventory`` (tracks) and a ``ledger``, only tracks that are new or changed since the ledger's last entry are worked on, and
    each batch records them in a ledger folder of its own, which a repeated delivery doesn't see and replaces. So a
    batch that was killed between both writes leaves nothing behind that a whole run wouldn't. All frames of a track must come
    in one file, as a scan writes them; a batch has whole files.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def take(batch: DataFrame, batch_id: int) -> None:
        label = f"stream-{stream}-{batch_id}"
        todo = None
        if inventory is not None and ledger is not None:
            others = read_ledger(batch.sparkSession, ledger).where(F.col("batch") != label)
            todo = fresh(inventory.join(batch.select("track_id").distinct(), "track_id", "left_semi"), others)
            batch = batch.join(todo.select("track_id"), "track_id", "left_semi")
        clean_frames(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if todo is not None:
            append_ledger(todo.select("path", "mtime", high_quality().alias("is_high")), ledger, label)

    return frames.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

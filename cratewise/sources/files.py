"""Readers and writers: folder inventories, collection files, ledgers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.functions.text import Text
from cratewise.operators.numbering import numbered

T = Text()
PREFIX = "file://localhost"
CUES = "array<struct<_Name:string,_Type:string,_Start:string,_Num:string>>"
TRACK = f"_Location string, _Name string, _Artist string, _Album string, _Genre string, _Comments string, _Tonality string, _AverageBpm string, _PercentEncoded string, _Rating string, _PlayCount string, _DateAdded string, POSITION_MARK {CUES}"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime, size_bytes of the audio files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][pP]3").load(folder)
    return files.select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size_bytes"))


def path_of_url(url):
    """A file URL's path: prefix off, percent signs decoded, plus signs as they are."""
    return F.url_decode(F.replace(F.substring(url, len(PREFIX) + 1, F.lit(1 << 20)), F.lit("+"), F.lit("%2B")))


def url_of_path(path):
    url = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        url = F.replace(url, F.lit(a), F.lit(b))
    return F.concat(F.lit(PREFIX), url)


#: Characters that XML can't hold: the writer fails at some of them, and a reader drops what holds the others.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
#: Attributes of free text.
FREE = ["_Name", "_Artist", "_Album", "_Genre", "_AverageBpm", "_Tonality", "_Comments"]


def percent_encoded(rows: DataFrame) -> DataFrame:
    """Attributes with characters that XML can't hold in percent signs, as in a URL; the attribute PercentEncoded names them. Other tracks stay as they are and have none."""
    bad = lambda c: F.col(c).rlike(NOT_XML)
    names = F.nullif(F.concat_ws(" ", *(F.when(bad(c), F.lit(c[1:])) for c in FREE)), F.lit(""))
    return rows.withColumns({"_PercentEncoded": names} | {c: F.when(bad(c), F.url_encode(c)).otherwise(F.col(c)) for c in FREE})


def percent_decoded(rows: DataFrame) -> DataFrame:
    """Attributes that PercentEncoded names as they were; what isn't encoded rightly stays as it stands."""
    named = F.split(F.coalesce("_PercentEncoded", F.lit("")), " ")
    return rows.withColumns({c: F.when(F.array_contains(named, c[1:]), F.coalesce(F.try_url_decode(c), c)).otherwise(F.col(c)) for c in FREE})


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection file's tracks, the last of each location: playlist entries have none and go; bad numbers are null."""
    reader = spark.read.format("xml").option("rowTag", "TRACK").option("ignoreSurroundingSpaces", False)
    rows = reader.schema(TRACK).load(path).where(F.col("_Location").startswith(PREFIX)).withColumn("ordinal", F.monotonically_increasing_id())
    rows = percent_decoded(rows)
    cues = F.transform(F.coalesce("POSITION_MARK", F.array().cast(CUES)), lambda c: F.struct(c["_Name"].alias("name"), c["_Type"].alias("type"), c["_Start"].try_cast("double").alias("time"), c["_Num"].try_cast("int").alias("num")))
    named = rows.select(
        path_of_url(F.col("_Location")).alias("path"), "ordinal", F.col("_Name").alias("title"), F.col("_Artist").alias("artist"), F.col("_Album").alias("album"), F.col("_Genre").alias("genre"),
        F.col("_Comments").alias("comment"), F.col("_Tonality").alias("key"), F.nullif(F.trim("_AverageBpm"), F.lit("")).try_cast("double").alias("bpm"),
        F.coalesce(F.col("_Rating").try_cast("int"), F.lit(0)).alias("rating"), F.coalesce(F.col("_PlayCount").try_cast("int"), F.lit(0)).alias("play_count"), F.col("_DateAdded").alias("date_added"), cues.alias("cue_points"),
    )
    last = named.groupBy("path").agg(F.max_by(F.struct(*(c for c in named.columns if c != "path")), "ordinal").alias("x"))
    return last.select("path", "x.*")


def collection_rows(tracks: DataFrame) -> DataFrame:
    """The export's columns of each track. The year is that of the recording date, else of the older frame."""
    year = F.coalesce(F.expr(T.year("coalesce(tdrc, tyer, '')")), F.lit(""))
    rows = numbered(tracks.select("path", "artist", "title", "album", "genre", "bpm", "key_tag", "comment", "length_s", "size_bytes", year.alias("year")), "path", "TrackID")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.col("TrackID").alias("_TrackID"), text("title").alias("_Name"), text("artist").alias("_Artist"), text("album").alias("_Album"), text("genre").alias("_Genre"), text("bpm").alias("_AverageBpm"),
        text("key_tag").alias("_Tonality"), text("comment").alias("_Comments"), F.col("year").alias("_Year"), F.col("size_bytes").cast("string").alias("_FileSize"), F.floor("length_s").alias("_TotalTime"), url_of_path(F.col("path")).alias("_Location"),
    )


def playlist_rows(tracks: DataFrame) -> DataFrame:
    """The playlist's entries: the numbers of all tracks."""
    return numbered(tracks.select("path"), "path", "_Key").select("_Key")


def write_collection(tracks: DataFrame, path: str, playlist: str | None = None) -> None:
    """The collection as XML below ``path``; a playlist of all tracks, if it has a name, beside it (``path``-playlist)."""
    entries = tracks.count()
    out = lambda rows, root, to: rows.write.format("xml").option("rootTag", root).option("rowTag", "TRACK").option("declaration", "version='1.0' encoding='UTF-8'").save(to)
    out(percent_encoded(collection_rows(tracks)), f"COLLECTION Entries='{entries}'", path)
    if playlist is not None:
        name = re.sub(r"[\s='\"]+", "_", playlist)  # the writer parts the root's attributes at spaces
        out(playlist_rows(tracks), f"NODE Name='{name}' Type='1' KeyType='0' Entries='{entries}'", f"{path}-playlist")


def bad_values(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many entries of a collection file have a tempo, rating or play count that is no number."""
    rows = spark.read.format("xml").option("rowTag", "TRACK").schema(TRACK).load(path).where(F.col("_Location").startswith(PREFIX))
    rows = percent_decoded(rows)
    bad = lambda c, kind: F.count_if((F.trim(F.coalesce(c, F.lit(""))) != "") & F.trim(c).try_cast(kind).isNull())
    return rows.agg(F.count("*").alias("entries"), bad(F.col("_AverageBpm"), "double").alias("bad_bpm"), bad(F.col("_Rating"), "int").alias("bad_rating"), bad(F.col("_PlayCount"), "int").alias("bad_play_count"))


#: What a ledger's files hold; each run, and each batch of a stream, has a folder ``batch=...`` of its own.
LEDGER = "path string, mtime double, last_processed timestamp, is_high_quality boolean, out_path string, batch string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's entries. A ledger that isn't there yet is empty, and a file that can't be read is passed over, so that its
    tracks are worked on again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("ignoreCorruptFiles", True).option("basePath", path).parquet(path)


def append_ledger(results: DataFrame, path: str, batch: str | None = None) -> None:
    """Record processed tracks: path, mtime, when, their quality and output. ``batch`` names the folder, which is replaced if it is there, so a
    batch that is delivered again leaves the ledger as it was; without it each call adds a folder. ``latest`` is the state."""
    out = F.col("out_path") if "out_path" in results.columns else F.lit(None)
    rows = results.select("path", F.col("mtime").cast("double").alias("mtime"), F.current_timestamp().alias("last_processed"), F.col("is_high").alias("is_high_quality"), out.cast("string").alias("out_path"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch or f'run-{uuid.uuid4().hex}'}")


def latest(ledger: DataFrame) -> DataFrame:
    """path, mtime, is_high_quality, entries: the ledger's state, which is each path's entry of the last run (of one run: the newest file).
    A bare list of path and mtime will do."""
    when = F.struct(*(c for c in ("last_processed", "mtime") if c in ledger.columns))
    quality = F.col("is_high_quality") if "is_high_quality" in ledger.columns else F.lit(None).cast("boolean").alias("is_high_quality")
    return ledger.groupBy("path").agg(F.max_by(F.struct("mtime", quality), when).alias("x"), F.count("*").alias("entries")).select("path", "x.*", "entries")

"""Tag maps of tracks: what all text frames were, what cleaning makes of them, and the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions import rules
from cratewise.functions.text import Text
from cratewise.operators.tracks import consolidate_comments
from cratewise.sources.shared import by_shuffle

T = Text()
ENTRIES = "array<struct<key:string,value:string>>"
COMMENT = "COMM::eng"
#: Fields in the order in which changes are told.
FIELDS = {**rules.FRAMES, "TDRC": "year", "TYER": "old_year", COMMENT: "comment"}


def value_of(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def with_year(entries: Column) -> Column:
    """Entries with the recording date's year; without a valid one, with that of the older frame, which then goes."""
    new = F.expr(T.year("tdrc"))
    old = F.expr(T.year("tyer"))
    rest = F.filter(entries, lambda e: (e["key"] != "TDRC") & ((e["key"] != "TYER") | new.isNotNull() | old.isNull()))
    year = F.coalesce(new, old)
    return F.concat(rest, F.when(year.isNotNull(), F.array(F.struct(F.lit("TDRC").alias("key"), year.alias("value")))).otherwise(F.array().cast(ENTRIES)))


def tag_maps(frames: DataFrame) -> DataFrame:
    """track_id, original, cleaned (maps of frame to text), diff (frame, field, old, new, action) of each track with text or comment frames.

    Known text frames are cleaned as lists of people or as texts, the year is repaired, and comments become one. Other text frames stay.
    Of several frames of one id the first by ``ord`` counts. ``diff`` is in the order of FIELDS, then by frame.
    """
    kept = frames.where("(frame_id LIKE 'T%' OR frame_id LIKE 'COMM%') AND text IS NOT NULL AND text <> ''")
    known = F.col("frame_id").isin(list(rules.FRAMES))
    clean = F.when(F.col("frame_id").isin(rules.PEOPLE_FRAMES), F.expr(T.people("text"))).when(known, F.expr(T.sanitize("text"))).when(~F.col("frame_id").startswith("COMM"), F.col("text"))
    first = kept.groupBy("track_id", "frame_id").agg(F.min_by("text", "ord").alias("text")).withColumn("new", clean)
    pair = lambda value: F.struct(F.col("frame_id").alias("key"), F.col(value).alias("value"))
    tracks = first.groupBy("track_id").agg(F.collect_list(pair("text")).alias("old"), F.collect_list(F.when(F.col("new").isNotNull(), pair("new"))).alias("new"))
    tracks = tracks.withColumns({"tdrc": value_of(F.col("old"), "TDRC"), "tyer": value_of(F.col("old"), "TYER")})
    comments = consolidate_comments(kept).where("comment IS NOT NULL").select("track_id", F.array(F.struct(F.lit(COMMENT).alias("key"), F.col("comment").alias("value"))).alias("said"))
    rows = tracks.join(by_shuffle(comments), "track_id", "left")
    sorted_map = lambda entries: F.map_from_entries(F.array_sort(entries))
    cleaned = F.concat(with_year(F.col("new")), F.coalesce("said", F.array().cast(ENTRIES)))
    maps = rows.select("track_id", sorted_map(F.col("old")).alias("original"), sorted_map(cleaned).alias("cleaned"))
    return maps.withColumn("diff", difference(F.col("original"), F.col("cleaned")))


def difference(original: Column, cleaned: Column) -> Column:
    """(at, frame, field, old, new, action) of the entries that two maps don't share."""
    order = F.array(*(F.lit(f) for f in FIELDS))
    names = F.array(*(F.lit(f) for f in FIELDS.values()))
    both = F.map_entries(F.map_zip_with(original, cleaned, lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))))
    changed = F.filter(both, lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"]))
    place = lambda key: F.array_position(order, key)

    def entry(e: Column) -> Column:
        at, old, new = place(e["key"]), e["value"]["old"], e["value"]["new"]
        action = F.when(old.isNull(), "Added").when(new.isNull(), "Removed").otherwise("Cleaned")
        return F.struct(F.when(at > 0, at).otherwise(len(FIELDS) + 1).alias("at"), e["key"].alias("frame"), F.when(at > 0, F.get(names, (at - 1).cast("int"))).otherwise(e["key"]).alias("field"), old.alias("old"), new.alias("new"), action.alias("action"))

    return F.array_sort(F.transform(changed, entry))


def shown(tag_map: Column) -> Column:
    """A map as text, by frame."""
    return F.array_join(F.transform(F.map_entries(tag_map), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def shown_difference(diff: Column) -> Column:
    """What happened to each text frame; comments aren't told here."""
    return F.array_join(F.transform(F.filter(diff, lambda d: ~d["frame"].startswith("COMM")), lambda d: F.concat(d["action"], F.lit(" "), d["field"])), "; ")

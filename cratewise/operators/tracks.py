"""Row-wise operators on tracks and tag frames: cleaning, parsing, rating, scoring, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.functions import rules
from cratewise.functions.text import Text
from cratewise.sources.shared import by_shuffle

T = Text()


def blank(name: str) -> Column:
    return F.expr(T.blank(name))


def kbps() -> Column:
    return F.floor(F.coalesce("bitrate_bps", F.lit(0)) / 1000).cast("int")


def high_quality() -> Column:
    """320 kbps, and 44 kHz unless the rate is unknown."""
    khz = F.col("sample_rate_hz") / 1000
    return (kbps() >= 320) & (khz.isNull() | (khz == 0) | (khz >= 44.0))


def shown_khz() -> Column:
    """The sampling rate as it is: 44.1, 22.05, 48.0."""
    return F.coalesce(F.col("sample_rate_hz") / 1000, F.lit(0.0)).cast("string")


def quality_report(tracks: DataFrame) -> DataFrame:
    """Stream facts of each track; a track without a bitrate is rated ERROR."""
    bad = F.col("bitrate_bps").isNull()
    khz = F.coalesce(F.col("sample_rate_hz") / 1000, F.lit(0.0))
    rating = F.when(bad, "ERROR").when(high_quality(), "HIGH").otherwise("LOW")
    seconds = F.floor(F.coalesce("length_s", F.lit(0.0))).cast("long")
    length = F.when(bad, "0:00").otherwise(F.concat((seconds / 60).cast("long").cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))
    return tracks.select("track_id", kbps().alias("kbps"), F.round(khz, 3).alias("khz"), length.alias("length"), (~bad & high_quality()).alias("is_high"), rating.alias("rating"))


def missing_fields(tracks: DataFrame) -> DataFrame:
    """A flag for each weighted field that is blank."""
    columns = {"title": "title", "artist": "artist", "bpm": "bpm", "key": "key_tag", "genre": "genre", "album": "album"}
    flags = {f: blank(c) for f, c in columns.items()}
    flags["energy"] = ~F.contains(F.lower(F.coalesce("comment", F.lit(""))), F.lit("energy:"))
    flags["year"] = blank("tdrc") & blank("tyer")
    return tracks.withColumns({f"no_{f}": flags[f] for f in rules.FIELD_WEIGHTS})


def missing_score(tracks: DataFrame) -> DataFrame:
    """track_id, path, missing_score, completion: the weight of blank fields, and the share of present ones."""
    score = sum((F.when(F.col(f"no_{f}"), w).otherwise(0) for f, w in rules.FIELD_WEIGHTS.items()), F.lit(0))
    total = sum(rules.FIELD_WEIGHTS.values())
    return missing_fields(tracks).withColumn("missing_score", score).select("track_id", "path", "missing_score", F.round((total - F.col("missing_score")) * 100.0 / total, 6).alias("completion"))


def gaps(tracks: DataFrame) -> DataFrame:
    """field, n_missing over all tracks."""
    pairs = ", ".join(f"'{f}', no_{f}" for f in rules.FIELD_WEIGHTS)
    long = missing_fields(tracks).select(F.expr(f"stack({len(rules.FIELD_WEIGHTS)}, {pairs}) AS (field, missing)"))
    return long.groupBy("field").agg(F.count_if("missing").alias("n_missing"))


def gaps_by_genre(tracks: DataFrame) -> DataFrame:
    """genre, field, level, n_tracks, n_missing: gaps of each field in each genre (level 0), of each genre (1), of each field (2) and of all (3)."""
    pairs = ", ".join(f"'{f}', no_{f}" for f in rules.FIELD_WEIGHTS)
    name = F.coalesce(F.nullif(F.trim("genre"), F.lit("")), F.lit("(none)"))
    long = missing_fields(tracks).select(name.alias("genre"), F.expr(f"stack({len(rules.FIELD_WEIGHTS)}, {pairs}) AS (field, missing)"))
    return long.cube("genre", "field").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_tracks"), F.count_if("missing").alias("n_missing"))


def most_urgent(tracks: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` tracks that miss most, by path where they tie."""
    return missing_score(tracks).orderBy(F.desc("missing_score"), "path").limit(n)


def clean_frames(frames: DataFrame) -> DataFrame:
    """A change log of the known text frames: what each was, is, and whether it was changed or removed."""
    known = frames.where(F.col("frame_id").isin(list(rules.FRAMES)) & F.col("text").isNotNull() & (F.col("text") != ""))
    after = F.when(F.col("frame_id").isin(rules.PEOPLE_FRAMES), F.expr(T.people("text"))).otherwise(F.expr(T.sanitize("text")))
    action = F.when(F.col("new_text").isNull(), "removed").when(F.col("new_text") != F.col("text"), "changed")
    rows = known.select("track_id", "frame_id", "ord", "text", after.alias("new_text")).withColumn("action", action)
    return rows.where("action IS NOT NULL").select("track_id", "frame_id", F.col("text").alias("old_text"), "new_text", "action")


def repair_year(tracks: DataFrame) -> DataFrame:
    """track_id, year, action: the recording date's year, else the older year frame's."""
    new, old = F.expr(T.year("tdrc")), F.expr(T.year("tyer"))
    action = F.when(new.isNotNull() & (new != F.col("tdrc")), "parsed").when(new.isNull() & old.isNotNull(), "migrated").when(new.isNull() & ~blank("tdrc"), "dropped").otherwise("kept")
    return tracks.select("track_id", F.coalesce(new, old).alias("year"), action.alias("action"))


def consolidate_comments(frames: DataFrame) -> DataFrame:
    """One comment a track, of the lines worth keeping, each once in order; null where nothing is left."""
    comments = frames.where("frame_id LIKE 'COMM%' AND text IS NOT NULL")
    spam = F.contains(F.lower("frame_id"), F.lit("itunnorm")) | F.contains(F.lower("text"), F.lit("itunes"))
    lines = F.when(spam, F.array().cast("array<string>")).otherwise(F.expr(T.comment_lines("text")))
    grouped = comments.select("track_id", F.struct("frame_id", "ord", lines.alias("lines")).alias("x")).groupBy("track_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.count("*").alias("n_frames"))
    kept = F.array_distinct(F.flatten(F.transform("x", lambda r: r["lines"])))
    return grouped.select("track_id", F.nullif(F.array_join(kept, "\n"), F.lit("")).alias("comment"), "n_frames")


def annotate(comment: Column, marker: str | Column, line: Column) -> Column:
    """The comment with a line appended, unless its marker stands there."""
    mark = F.lit(marker) if isinstance(marker, str) else marker
    return F.when(F.contains(F.coalesce(comment, F.lit("")), mark), comment).otherwise(F.concat_ws("\n", F.nullif(comment, F.lit("")), line))


def quality_line() -> Column:
    """The comment line with a track's stream facts."""
    return F.concat(F.format_string("QUALITY: %dkbps, ", kbps()), shown_khz(), F.lit("kHz, "), F.when(high_quality(), "HIGH").otherwise("LOW"))


def planned_names(tracks: DataFrame) -> DataFrame:
    """track_id, path, folder, stem: the file name that cleaned tags (or, without any, the file's name) ask for."""
    artist, title = T.or_name_part(T.clean("artist"), T.clean("title"), "path")
    rows = tracks.select("track_id", "path", F.expr(artist).alias("a"), F.expr(title).alias("t"), F.coalesce(F.expr(T.year("coalesce(nullif(tdrc, ''), tyer)")), F.lit("")).alias("y"))
    return rows.select("track_id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_replace(F.expr(T.file_name("a", "t", "y")), r"\.mp3$", "").alias("stem"))


def without_clashes(planned: DataFrame, kept: DataFrame) -> DataFrame:
    """``planned`` (track_id, path, folder, stem) with name: of those with one stem in a folder, in order of path, each the first free one of
    ``stem.mp3``, ``stem (1).mp3`` and so on. The files of ``kept`` (path) hold their names.

    A name with a number can be asked for in two ways only: as a stem, or as the numbered form of the stem before the number. Numbers that
    make a planned stem aren't free, so the first way goes before and no two tracks get one name.
    """
    folder, file = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.mp3$", "")
    held = kept.select(folder.alias("folder"), file.alias("file"))
    suffix = r"^(.*) \(([1-9][0-9]{0,8})\)$"
    names = held.unionByName(planned.select("folder", F.col("stem").alias("file")).distinct()).where(F.col("file").rlike(suffix))
    numbered = names.select("folder", F.regexp_extract("file", suffix, 1).alias("stem"), F.regexp_extract("file", suffix, 2).cast("int").alias("k"))
    taken = held.select("folder", F.col("file").alias("stem"), F.lit(0).alias("k")).unionByName(numbered).join(by_shuffle(planned.select("folder", "stem").distinct()), ["folder", "stem"], "left_semi")
    taken = taken.groupBy("folder", "stem").agg(F.array_sort(F.collect_set("k")).alias("taken"))
    n = (F.row_number().over(Window.partitionBy("folder", "stem").orderBy("path")) - 1).cast("int")
    rows = planned.withColumn("n", n).join(by_shuffle(taken), ["folder", "stem"], "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("n"), lambda at, k: F.when(k <= at, at + 1).otherwise(at))
    name = F.concat("stem", F.when(free > 0, F.concat(F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise(""), F.lit(".mp3"))
    return rows.select("track_id", "path", "folder", name.alias("name"))


def output_names(tracks: DataFrame) -> DataFrame:
    """track_id, path, folder, name: the planned file name of each track, with its suffix where names of a folder collide."""
    return without_clashes(planned_names(tracks), tracks.select("path").limit(0))


def output_plan(tracks: DataFrame, high_quality_only: bool = False) -> DataFrame:
    """track_id, path, out_path, moved, action: where each track's file goes. If only high quality is wanted, others are skipped: they neither move nor hold a name."""
    moved = tracks.where(high_quality()) if high_quality_only else tracks
    names = output_names(moved).select("track_id", F.concat_ws("/", "folder", "name").alias("out_path"))
    rows = tracks.select("track_id", "path").join(by_shuffle(names), "track_id", "left")
    action = F.when(F.col("out_path").isNull(), "skipped").when(F.col("out_path") != F.col("path"), "renamed").otherwise("kept")
    return rows.select("track_id", "path", "out_path", F.col("out_path").isNotNull().alias("moved"), action.alias("action"))

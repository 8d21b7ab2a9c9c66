"""The whole job over a library: skip known files, rate, clean, enrich, analyse, plan names, record, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import Text
from cratewise.operators import catalogue, duplicates, features
from cratewise.operators.tags import shown_difference, tag_maps
from cratewise.operators.tracks import annotate, high_quality, kbps, quality_line, without_clashes
from cratewise.sources import files
from cratewise.sources.shared import by_shuffle, written
from cratewise.streaming.intake import fresh, skipped

T = Text()


@dataclass
class Options:
    """What a run does besides cleaning."""

    incremental: bool = True
    analyse_quality: bool = True
    high_quality_only: bool = False
    use_collection: bool = True
    use_catalogue: bool = True
    detect_key: bool = True
    detect_cues: bool = True
    rate_energy: bool = True
    normalise_loudness: bool = True
    target_lufs: float = -14.0
    rename: bool = True
    year_in_name: bool = True


#: Tables of a run, in the order of ``process``.
TABLES = ("tracks", "ledger", "collection", "recordings", "releases", "audio_frames", "chroma", "loudness")
MORE_TABLES = ("tag_frames", "beats")


def process(
    tracks: DataFrame, ledger: DataFrame, collection: DataFrame, recordings: DataFrame, releases: DataFrame, frames: DataFrame, chroma: DataFrame, loudness: DataFrame,
    options: Options | None = None, tag_frames: DataFrame | None = None, beats: DataFrame | None = None,
) -> DataFrame:
    """One row a processed track: rating, cleaned and enriched tags, analyses, what changed, and the planned name.

    Low-quality tracks are recorded, but not worked on if only high quality is wanted. Names change only where the catalogue's match was
    accepted, if there is a catalogue. Comments get the quality line, then are cleaned, then get the lines of the collection, key, cues, energy and
    loudness. With ``tag_frames``, all text frames are cleaned and told in maps; without ``beats`` there are no cues.
    """
    o = options or Options()
    todo = fresh(tracks, ledger) if o.incremental else tracks
    todo = written(todo.repartition(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id"), "todo")  # all that follows reads this
    work = todo.where(high_quality()) if o.high_quality_only else todo
    khz = F.coalesce(F.col("sample_rate_hz") / 1000, F.lit(0.0))
    rows = todo.select("track_id", "path", "mtime", kbps().alias("kbps"), khz.alias("khz"), high_quality().alias("is_high"), (high_quality() | F.lit(not o.high_quality_only)).alias("moved"))
    rated = annotate(F.col("comment"), quality_line(), quality_line()) if o.analyse_quality else F.col("comment")
    tags = work.withColumn("rated", rated).select(
        "track_id", *(F.expr(T.sanitize(c)).alias(c) for c in ("title", "album")), F.expr(T.people("artist")).alias("artist"), F.coalesce(F.expr(T.year("tdrc")), F.expr(T.year("tyer"))).alias("year"),
        (~F.col("rated").eqNullSafe(F.col("comment"))).alias("rated"), F.expr(T.consolidated("rated")).alias("comment"), F.expr(f"({T.consolidated('rated')}) IS NOT NULL").alias("kept_comment"), (F.coalesce("rated", F.lit("")) != "").alias("had_comment"),
    )
    collected = ["track_id", "path", "bpm", "key_tag", "genre", "comment"]
    kept = work.drop("comment").join(by_shuffle(tags.select("track_id", "comment")), "track_id").select(collected)
    if o.use_collection:
        own = catalogue.enrich_from_collection(kept, collection).withColumnRenamed("matched", "in_collection")
    else:
        own = kept.drop("path").withColumn("in_collection", F.lit(False))
    own = own.withColumn("genre", F.expr(T.sanitize("genre")))
    if o.use_catalogue:
        found = catalogue.enrich(work, recordings, releases)
    else:
        none = ["new_artist", "new_title", "new_year", "new_album", "new_genre", "new_bpm", "found_year", "found_album"]
        found = work.select("track_id", F.lit(None).cast("string").alias("method"), F.lit("unasked").alias("outcome"), *(F.lit(None).cast("string").alias(c) for c in none))
    if tag_frames is not None:
        maps = tag_maps(tag_frames.join(by_shuffle(work.select("track_id")), "track_id", "left_semi"))
    else:
        maps = work.select("track_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("original", "map<string,string>"), ("cleaned", "map<string,string>"), ("diff", "array<struct<at:int,frame:string,field:string,old:string,new:string,action:string>>"))))
    key = features.musical_key(chroma).select("track_id", F.col("key").alias("found_key"), "camelot")
    cues = features.cue_points(frames, beats if beats is not None else frames.select("track_id", F.col("frame_idx").alias("beat_idx"), "t_s"))
    wanted = [(o.detect_key, key), (o.rate_energy, features.energy(frames)), (o.detect_cues and beats is not None, cues), (o.normalise_loudness, features.loudness_plan(loudness, o.target_lufs).select("track_id", "gain_db"))]
    for part in (tags.drop("comment"), own, found, maps, *(made if asked else made.limit(0) for asked, made in wanted)):
        rows = rows.join(by_shuffle(part), "track_id", "left")
    rows = rows.withColumn("enhanced", F.coalesce(F.col("outcome") == "accepted", F.lit(False)))
    for c in ("artist", "title", "album", "year", "genre"):
        rows = rows.withColumn(c, F.coalesce(f"new_{c}", c))
    artist, title = T.or_name_part("artist", "title", "path")
    rows = rows.withColumn("set_bpm", F.col("new_bpm").isNotNull() & F.expr(f"bpm IS NULL OR NOT {T.number('bpm')}")).withColumn("bpm", F.when(F.col("set_bpm"), F.col("new_bpm")).otherwise(F.col("bpm")))
    analysed = ("found_key", "camelot", "energy", "intro_end", "drops", "outro_start", "recommended", "gain_db")
    rows = rows.withColumns({"artist": F.when(F.col("moved"), F.expr(artist)), "title": F.when(F.col("moved"), F.expr(title)), **{c: F.when(F.col("moved"), F.col(c)) for c in analysed}})
    rows = rows.withColumn("key_tag", F.coalesce("found_key", "key_tag"))
    for marker, line in comment_lines(o):
        rows = rows.withColumn("comment", F.expr(T.annotate("comment", marker, line)))
    return _named(written(rows, "library"), o, ledger)


def comment_lines(o: Options, t: Text = T) -> list[tuple[str, str]]:
    """Marker and line of each analysis, in the order in which comments get them; a line without a result is null."""
    number = (lambda x, form: f"format_string('{form}', {x})") if t.spark else (lambda x, form: f"printf('{form}', {x})")
    tenth = lambda x: number(f"round({x}, 1)", "%.1f")
    drops = f"CASE WHEN drops <> '' THEN ', Drops: ' || replace(drops, ',', 's, ') || 's' ELSE '' END"
    cues = f"'DJ Cues - Intro: ' || {tenth('intro_end')} || 's, Outro: ' || {tenth('outro_start')} || 's' || {drops}"
    nothing = "cast(NULL AS string)" if t.spark else "cast(NULL AS varchar)"
    only = lambda column, line: f"CASE WHEN {column} IS NOT NULL THEN {line} ELSE {nothing} END"
    key = only("camelot", "'Camelot key: ' || camelot")
    loud = f"'Loudness normalized to {o.target_lufs} LUFS'"
    return [(f"coalesce({key}, '')", key), ("'DJ Cues -'", only("intro_end", cues)), ("'Energy:'", only("energy", f"'Energy: ' || {tenth('energy')} || '/10'")), ("'Loudness normalized'", only("gain_db", loud))]


def _named(rows: DataFrame, o: Options, ledger: DataFrame) -> DataFrame:
    """``rows`` with output path, action and the texts of all changes. Files that stay, and outputs of earlier runs, hold their names; a file that
    would stay where an earlier run put another one gets a number as well."""
    renamed = F.col("moved") & (F.col("enhanced") if o.use_catalogue else F.lit(o.rename)) & F.lit(o.rename)
    year = F.coalesce(F.expr(T.year_of_date("year")), F.lit("")) if o.year_in_name else F.lit("")
    stem = F.regexp_replace(F.expr(T.file_name("artist", "title", "y")), r"\.mp3$", "")
    planned = rows.where(renamed).withColumn("y", year).select("track_id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), stem.alias("stem"))
    earlier = ledger.where("out_path IS NOT NULL").select(F.col("out_path").alias("path")) if "out_path" in ledger.columns else rows.limit(0).select("path")
    earlier = written(earlier.distinct(), "earlier-outputs")
    stays = rows.where(F.col("moved") & ~renamed)
    own = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.mp3$", "")
    taken = stays.join(by_shuffle(earlier), "path", "left_semi").select("track_id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), own.alias("stem"))
    names = without_clashes(planned.unionByName(taken), stays.select("path").unionByName(earlier)).select("track_id", F.concat_ws("/", "folder", "name").alias("new_path"))
    numbered = F.when(renamed, F.col("new_path")).otherwise(F.concat(F.regexp_replace("new_path", r"\.mp3$", ""), F.regexp_extract("path", r"(?i)(\.mp3)?$", 0)))
    rows = rows.join(by_shuffle(names), "track_id", "left").withColumn("out_path", F.when(F.col("moved"), F.coalesce(numbered, F.col("path"))))
    rows = rows.withColumn("action", F.when(~F.col("moved"), "skipped").when(F.col("out_path") != F.col("path"), "renamed").otherwise("kept"))
    name = F.element_at(F.split("out_path", "/"), -1)
    said = F.array_compact(F.array(
        F.when(F.lit(o.analyse_quality), F.concat(F.format_string("Quality analyzed: %dkbps @ ", "kbps"), F.col("khz").cast("string"), F.lit("kHz"))), F.when(F.col("rated"), F.lit("Added quality comment")),
        F.nullif(shown_difference(F.col("diff")), F.lit("")), F.when(F.col("had_comment"), F.when(F.col("kept_comment"), "Consolidated comments").otherwise("Removed comments")),
        F.when(F.col("in_collection"), "Applied collection metadata"), F.when(F.col("enhanced"), "Enhanced from catalogue"),
        F.when(F.col("found_key").isNotNull(), F.concat(F.lit("Detected key: "), F.col("found_key"))),
        F.when(F.col("intro_end").isNotNull(), F.concat(F.format_string("Detected cue points: Intro: %.4fs, Outro: %.4fs", "intro_end", "outro_start"), *(F.when(F.col(c) != "", F.concat(F.lit(f", {c.title()}: "), F.replace(c, F.lit(","), F.lit("s, ")), F.lit("s"))).otherwise("") for c in ("drops", "recommended")))),
        F.when(F.col("energy").isNotNull(), F.format_string("Energy rating: %.1f/10", "energy")),
        F.when(F.col("gain_db").isNotNull(), F.lit(f"Normalized loudness to {o.target_lufs} LUFS")),
        F.when(F.col("action") == "renamed", F.concat(F.lit("Renamed to: "), name)).otherwise("Kept original filename"),
    ))
    changes = F.when(F.col("moved"), F.array_join(said, "; ")).otherwise("Skipped - low quality (no changes made)")
    return rows.select(
        "track_id", "path", "mtime", "kbps", "khz", "is_high", "moved", "artist", "title", "album", "year", "genre", "bpm", "set_bpm", "key_tag", "comment", "original", "cleaned", "found_key", "camelot", "energy", "intro_end", "drops", "outro_start",
        "recommended", "gain_db", "in_collection", "method", "outcome", "found_year", "found_album", "enhanced", "out_path", "action", changes.alias("changes"),
    )


COUNTERS: dict[str, str] = {
    "high_quality": "is_high", "low_quality": "NOT is_high", "quality_analyzed": "kbps IS NOT NULL", "text_search_hits": "method = 'text'", "fingerprint_hits": "method = 'fingerprint'",
    "identification_failures": "outcome IN ('rejected', 'unmatched')", "manual_review": "outcome = 'unmatched'", "year_found": "found_year IS NOT NULL", "album_found": "found_album IS NOT NULL",
    "genre_found": "method IS NOT NULL", "bpm_found": "set_bpm", "key_found": "found_key IS NOT NULL", "energy_rated": "energy IS NOT NULL", "cue_points_detected": "intro_end IS NOT NULL",
    "loudness_normalized": "gain_db IS NOT NULL", "in_collection": "in_collection", "enhanced": "enhanced", "renamed": "action = 'renamed'",
}


def totals(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row of counters of a run; ``known``, the tracks skipped as known, count as processed with the quality that they have."""
    own = results.select("track_id", *(F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in COUNTERS.items()))
    if known is not None:
        carried = {"high_quality": high_quality(), "low_quality": ~high_quality()}
        own = own.unionByName(known.select("track_id", *(carried.get(n, F.lit(False)).alias(n) for n in COUNTERS)))
    return own.agg(F.count("*").alias("processed"), *(F.count_if(n).alias(n) for n in COUNTERS))


def rates(counters: DataFrame) -> DataFrame:
    """Success of identification, and how often it found year, album, genre and tempo, in per cent; null without any."""
    hits = F.col("text_search_hits") + F.col("fingerprint_hits")
    share = lambda x, of: F.round(F.try_divide(100.0 * x, of), 6)
    return counters.select(share(hits, hits + F.col("identification_failures")).alias("success_rate"), *(share(F.col(f"{c}_found"), hits).alias(f"{c}_rate") for c in ("year", "album", "genre", "bpm")))


def low_quality(results: DataFrame, tracks: DataFrame) -> DataFrame:
    """path, kbps, khz, length (m:ss) of what needs replacement."""
    seconds = F.floor(F.coalesce("length_s", F.lit(0.0))).cast("long")
    length = F.concat((seconds / 60).cast("long").cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return results.where("NOT is_high").join(by_shuffle(tracks.select("track_id", length.alias("length"))), "track_id").select("path", "kbps", F.round("khz", 3).alias("khz"), "length")


def report(results: DataFrame) -> DataFrame:
    """The library report: renames, and tracks for review, with what happened to each."""
    rows = results.where("action = 'renamed' OR outcome = 'unmatched'")
    return rows.select("track_id", F.when(F.col("action") == "renamed", "renamed").otherwise("review").alias("kind"), "path", "out_path", "enhanced")


def run(tables: dict[str, DataFrame], out: str, ledger: str, options: Options | None = None) -> DataFrame:
    """Process, then write below ``out`` the results, the collection file's rows and all reports, and append to the ledger at ``ledger``; gives the results as written."""
    spark = tables["tracks"].sparkSession
    process(*(tables[n] for n in TABLES), options, **{n: tables[n] for n in MORE_TABLES if n in tables}).write.mode("overwrite").parquet(f"{out}/results")
    results, tracks = spark.read.parquet(f"{out}/results"), tables["tracks"]
    known = skipped(tracks, tables["ledger"]) if (options or Options()).incremental else None
    reports = {
        "summary": totals(results, known), "rates": rates(totals(results)), "low_quality": low_quality(results, tracks), "changes": results.select("path", "changes"),
        "library": report(results), "duplicates": duplicates.report(tracks),
    }
    for name, rows in reports.items():
        rows.write.mode("overwrite").parquet(f"{out}/reports/{name}")
    files.append_ledger(results, ledger)
    return results


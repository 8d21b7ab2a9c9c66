"""Queries by name, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.functions import rules
from cratewise.functions import tables as tables_of_rules
from cratewise.functions.text import Text
from cratewise.operators import catalogue, duplicates, features, tags, tracks
from cratewise.plans import library
from cratewise.sources import files
from cratewise.sources.library import view, with_views
from cratewise.sources.shared import shared_folder
from cratewise.streaming import intake

S, D = Text(), Text(spark=False)
Query = Callable[[SparkSession, str], DataFrame]

#: Projections of tracks: name, (column, expression of either dialect).
COLUMNS: dict[str, list[tuple[str, Callable[[Text], str]]]] = {
    "clean_text": [("title", lambda t: t.clean("title"))],
    "sanitize": [("artist", lambda t: t.sanitize("artist")), ("genre", lambda t: t.sanitize("genre"))],
    "sanitize_strict": [("title", lambda t: t.strict("title")), ("artist", lambda t: t.strict("artist"))],
    "normalize_people": [("artist", lambda t: t.people("artist"))],
    "parse_year": [("tdrc_year", lambda t: t.year("tdrc")), ("tyer_year", lambda t: t.year("tyer"))],
    "year_from_date": [("year", lambda t: t.year_of_date("tdrc"))],
    "polluted_tags": [("title_polluted", lambda t: t.polluted("title")), ("comment_polluted", lambda t: t.polluted("comment"))],
    "download_sites": [("sites", lambda t: t.join(t.download_sites("comment"), t.lit("|"))), ("title_sites", lambda t: t.join(t.download_sites("title"), t.lit("|")))],
    "match_key": [("match_key", lambda t: t.match_key("title"))],
    "output_name": [("name", lambda t: t.file_name("artist", "title", f"coalesce({t.year('tdrc')}, '')"))],
    "infer_genre": [("genre", lambda t: t.genre_of_path("path", "genre"))],
    "determine_genre": [("genre", lambda t: t.genre_of_text("artist", "title", "album"))],
    "genre_canonical": [("genre", lambda t: t.lookup("lower(genre)", rules.GENRE_NAMES, "genre"))],
    "bpm_estimate": [("bpm", lambda t: t.lookup("genre", rules.GENRE_BPM, "'120'"))],
    "bpm_policy": [("set_bpm", lambda t: f"bpm IS NULL OR NOT {t.number('bpm')}")],
    "filename_parse": [
        ("stem_artist", lambda t: t.name_parts("path")[0]), ("stem_title", lambda t: t.name_parts("path")[1]),
        ("parsed_artist", lambda t: t.or_name_part("artist", "title", "path")[0]), ("parsed_title", lambda t: t.or_name_part("artist", "title", "path")[1]),
    ],
}

HIGH = "bitrate_bps IS NOT NULL AND floor(bitrate_bps / 1000) >= 320 AND (sample_rate_hz IS NULL OR sample_rate_hz = 0 OR sample_rate_hz / 1000e0 >= 44.0)"
KEYS = "lower(trim(coalesce(artist, ''))) AS artist, lower(coalesce(nullif(trim(title), ''), cast(track_id AS varchar))) AS title"


def over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(view(spark, sf_dir, name))


def projected(columns: list[tuple[str, Callable[[Text], str]]]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("track_id", *(F.expr(e(S)).alias(n) for n, e in columns))


def both(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))


def key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.musical_key(features.chroma_frames(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def clean_exact(df: DataFrame) -> DataFrame:
    """Exact duplicates among high-quality tracks after cleaning."""
    return duplicates.exact(df.where(tracks.high_quality()).withColumn("title", F.expr(S.clean("title"))).withColumn("artist", F.expr(S.clean("artist"))))


def strict_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(tracks.high_quality().alias("is_high")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def snapshot(frames: DataFrame) -> DataFrame:
    kept = frames.where("(frame_id LIKE 'T%' OR frame_id LIKE 'COMM%') AND text IS NOT NULL AND text <> ''")
    return kept.groupBy("track_id").agg(F.count("*").alias("n_frames"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "frame_id", "text"))), ";").alias("tags"))


def changes(frames: DataFrame) -> DataFrame:
    """Each changed track's fields, what they were and are, in order of the frames."""
    said = F.concat(F.col("frame_id"), F.lit(": "), F.col("old_text"), F.lit(" -> "), F.coalesce("new_text", F.lit("(removed)")))
    return tracks.clean_frames(frames).groupBy("track_id").agg(F.count("*").alias("n_changes"), F.count_if(F.col("action") == "removed").alias("n_removed"), F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("changes"))


def annotated(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Energy: "), F.format_string("%.1f", (F.col("track_id") % 100) / 10), F.lit("/10"))
    return df.select("track_id", tracks.annotate(F.col("comment"), "Energy:", line).alias("comment"))


def gated(a: DataFrame, b: DataFrame) -> DataFrame:
    """The gate on tracks and the recordings of their own fingerprints."""
    other = b.select("fingerprint", F.col("artist").alias("new_artist"), F.col("title").alias("new_title"), "recording_id")
    rows = a.join(other, "fingerprint")
    return rows.select("track_id", "recording_id", F.expr(S.gate("artist", "title", "tdrc", "new_artist", "new_title", "'2001'")).alias("accepted"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The whole job's tables by name."""
    found = {n: view(spark, sf_dir, n) for n in ("tracks", "ledger", "collection", "recordings", "releases", "audio_frames", "loudness", "tag_frames", "beats")}
    return found | {"chroma": features.chroma_frames(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return library.process(*(t[n] for n in library.TABLES), **{n: t[n] for n in library.MORE_TABLES})


def process_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("track_id", "path", "kbps", "is_high", "artist", "title", "album", "year", "genre", "bpm", "key_tag", "comment", "found_key", "energy", "intro_end", "outro_start", "gain_db", "in_collection", "method", "outcome", "out_path", "action", "changes")


def stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.totals(results(spark, sf_dir), intake.skipped(view(spark, sf_dir, "tracks"), view(spark, sf_dir, "ledger")))


def names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks in one folder, renamed, beside the files of the even ones, which keep their names."""
    planned = tracks.planned_names(view(spark, sf_dir, "tracks")).withColumn("folder", F.lit("/out"))
    kept = planned.where("track_id % 2 = 0").select(F.concat_ws("/", "folder", F.concat("stem", F.lit(".mp3"))).alias("path"))
    return tracks.without_clashes(planned.where("track_id % 2 = 1"), kept).select("track_id", "name")


def session(tracks_: DataFrame, ledger: DataFrame) -> DataFrame:
    rows = intake.fresh(tracks_, ledger)
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    names = ["processed", "high_quality", "low_quality", "duplicate_groups"]
    high = tracks.high_quality()
    one = rows.agg(F.count("*").alias(names[0]), F.count_if(high).alias(names[1]), F.count_if(~high).alias(names[2])).select(*names[:3], *zero(names[3]))
    two = duplicates.exact(tracks_).agg(F.count("*").alias(names[3])).select(*zero(*names[:3]), names[3])
    return one.unionByName(two).agg(*(F.sum(n).alias(n) for n in names))


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in rules, and a user's: names of regions go from texts, those of nations tell a genre."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit("promotion").alias("list"), (F.col("r_regionkey") + 100.0).alias("priority"), F.concat(F.lit(r"(?i)\b"), F.lower("r_name"), F.lit(r"\b")).alias("pattern"), F.lit(None).cast("string").alias("value"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit(tables_of_rules.GENRE).alias("list"), (F.col("n_nationkey") + 100.0).alias("priority"), F.lower("n_name").alias("pattern"), F.lit("World Music").alias("value"))
    return tables_of_rules.defaults(spark).unionByName(regions).unionByName(nations)


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's first line, under the name of title."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("track_id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"))


def clean_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables_of_rules.text_with(user_rules(spark, sf_dir))
    return first_lines(spark, sf_dir).select("track_id", F.expr(t.clean("title")).alias("title"))


def genre_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_lines(spark, sf_dir).select("track_id", tables_of_rules.genre_of(F.col("title"), user_rules(spark, sf_dir)).alias("genre"))


def collection_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks written as a collection file and read back."""
    path = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    files.write_collection(view(spark, sf_dir, "tracks"), path)
    return files.read_collection(spark, path).select("path", "title", "artist", "album", "genre", "comment", "key", "bpm", "rating", "play_count", F.size("cue_points").alias("n_cues"))


def under_titles(paths: DataFrame, titles: DataFrame, folder: str) -> DataFrame:
    """Rows under the file names of their tracks' titles."""
    own = titles.select("track_id", F.concat(F.lit(folder), F.translate("title", "/", "-"), F.lit(".mp3")).alias("path"))
    return paths.drop("path").join(own, "track_id")


def fuzzy(t: DataFrame, c: DataFrame) -> DataFrame:
    """Tracks against a collection that was kept elsewhere, so that only file names agree."""
    return catalogue.enrich_by_like_names(under_titles(t, t, "/music/"), under_titles(c.withColumn("track_id", F.col("ordinal")), t, "/usb/"))


#: Kinds of duplicates by equality, which SQL can tell as well.
EQUAL_KINDS = [k for k in duplicates.KINDS if k != "similar_title"]
QUERIES: dict[str, Query] = {name: over("tracks", projected(columns)) for name, columns in COLUMNS.items()} | {
    "clean_by_rules": clean_by_rules,
    "genre_by_rules": genre_by_rules,
    "dup_exact": over("tracks", clean_exact),
    "dup_similar": over("tracks", duplicates.similar),
    "dup_similar_lev": over("tracks", duplicates.similar_by_edits),
    "dup_audio": over("tracks", duplicates.audio),
    "dup_all": over("tracks", duplicates.numbered_groups),
    "dup_report": over("tracks", duplicates.report),
    "dup_groups": over("tracks", lambda t: duplicates.numbered_groups(t, kinds=EQUAL_KINDS)),
    "dup_group_members": over("tracks", lambda t: duplicates.report(t, kinds=EQUAL_KINDS)),
    "quality_report": over("tracks", tracks.quality_report),
    "high_quality": over("tracks", lambda t: t.where(tracks.high_quality()).select("track_id", "path")),
    "strict_partition": over("tracks", strict_partition),
    "low_quality_list": over("tracks", lambda t: t.where(~tracks.high_quality()).select("path", tracks.kbps().alias("kbps"), F.round(F.coalesce(F.col("sample_rate_hz") / 1000, F.lit(0.0)), 3).alias("khz"), F.round("length_s", 3).alias("length_s"))),
    "missing_score": over("tracks", lambda t: tracks.missing_score(t).drop("completion")),
    "completion_pct": over("tracks", lambda t: tracks.missing_score(t).select("track_id", "completion")),
    "gap_by_field": over("tracks", tracks.gaps),
    "gap_by_genre": over("tracks", tracks.gaps_by_genre),
    "priority_top20": over("tracks", tracks.most_urgent),
    "tag_maps": over("tag_frames", lambda f: tags.tag_maps(f).select("track_id", tags.shown(F.col("original")).alias("original"), tags.shown(F.col("cleaned")).alias("cleaned"), tags.shown_difference(F.col("diff")).alias("changes"))),
    "clean_tags": over("tag_frames", tracks.clean_frames),
    "tag_snapshot": over("tag_frames", snapshot),
    "comment_consolidate": over("tag_frames", tracks.consolidate_comments),
    "changes_report": over("tag_frames", changes),
    "year_repair": over("tracks", tracks.repair_year),
    "annotate_comments": over("tracks", annotated),
    "output_plan": over("tracks", lambda t: tracks.output_plan(t, high_quality_only=True)),
    "name_collisions": names_query,
    "file_url": over("tracks", lambda t: t.select("track_id", files.path_of_url(files.url_of_path(F.col("path"))).alias("path"), files.url_of_path(F.col("path")).alias("url"))),
    "incremental_new": both(lambda t, l: intake.fresh(t, l).select("path", "mtime"), "tracks", "ledger"),
    "incremental_skipped": both(lambda t, l: intake.skipped(t, l).select("path", "mtime"), "tracks", "ledger"),
    "ledger_latest": over("ledger", files.latest),
    "collection_enrich": both(catalogue.enrich_from_collection, "tracks", "collection"),
    "collection_fuzzy": both(fuzzy, "tracks", "collection"),
    "identify_text": both(catalogue.identify_by_text, "tracks", "recordings"),
    "identify_fingerprint": both(catalogue.identify_by_fingerprint, "tracks", "recordings"),
    "match_gate": both(gated, "tracks", "recordings"),
    "release_first": over("releases", catalogue.first_release),
    "catalog_enrich": both(catalogue.enrich, "tracks", "recordings", "releases"),
    "dynamic_range": over("audio_frames", features.dynamic_range),
    "energy_rating": over("audio_frames", features.energy),
    "cue_change_ratio": both(features.cue_ratios, "audio_frames", "beats"),
    "cue_points": both(features.cue_points, "audio_frames", "beats"),
    "loudness_plan": over("loudness", features.loudness_plan),
    "musical_key": key_query,
    "process_library": process_query,
    "run_stats": stats_query,
    "match_rates": lambda spark, d: library.rates(library.totals(results(spark, d))),
    "low_quality_report": lambda spark, d: library.low_quality(results(spark, d), view(spark, d, "tracks")),
    "rename_report": lambda spark, d: library.report(results(spark, d)),
    "ledger_append": lambda spark, d: results(spark, d).select("path", "mtime", F.col("is_high").alias("is_high_quality")),
    "session_summary": both(session, "tracks", "ledger"),
    "collection_import": collection_import,
    "collection_export": over("tracks", files.collection_rows),
    "collection_playlist": over("tracks", files.playlist_rows),
    "dup_exact_raw": over("tracks", duplicates.exact),
    "dup_exact_normalized": over("tracks", lambda t: duplicates.exact(t, normalized=True)),
    "dup_members": over("tracks", lambda t: duplicates.members(t)),
    "people_tokens": over("tracks", lambda t: t.select("track_id", F.array_join(F.array_sort(F.expr(S.tokens("artist"))), "|").alias("tokens"))),
    "quality_line": over("tracks", lambda t: t.where("bitrate_bps IS NOT NULL").select("track_id", tracks.quality_line().alias("line"))),
}


def scores() -> str:
    cases = {"title": "title", "artist": "artist", "bpm": "bpm", "key": "key_tag", "genre": "genre", "album": "album"}
    flags = {f: D.blank(c) for f, c in cases.items()} | {"energy": "NOT contains(lower(coalesce(comment, '')), 'energy:')", "year": f"{D.blank('tdrc')} AND {D.blank('tyer')}"}
    return "SELECT *, " + ", ".join(f"({flags[f]}) AS no_{f}" for f in rules.FIELD_WEIGHTS) + " FROM tracks"


SCORE = " + ".join(f"CASE WHEN no_{f} THEN {w} ELSE 0 END" for f, w in rules.FIELD_WEIGHTS.items())
CLEANED = f"""SELECT track_id, frame_id, text AS old_text, CASE WHEN frame_id IN ({', '.join(map(D.lit, rules.PEOPLE_FRAMES))}) THEN {D.people('text')} ELSE {D.sanitize('text')} END AS new_text
 FROM tag_frames WHERE frame_id IN ({', '.join(map(D.lit, rules.FRAMES))}) AND text IS NOT NULL AND text <> ''"""
LOG = f"SELECT *, CASE WHEN new_text IS NULL THEN 'removed' ELSE 'changed' END AS action FROM ({CLEANED}) c WHERE new_text IS DISTINCT FROM old_text"
LATEST = "SELECT path, arg_max(mtime, last_processed) AS mtime, arg_max(is_high_quality, last_processed) AS is_high_quality, count(*) AS entries FROM ledger GROUP BY path"
TITLE_OR_STEM = "coalesce(nullif(trim(title), ''), cast(track_id AS varchar))"
JOB = ("tracks", "ledger", "collection", "recordings", "releases", "audio_frames", "loudness", "tag_frames", "beats")
COLLECTED = f"""SELECT track_id, CASE WHEN {D.blank('t.bpm')} THEN printf('%.2f', c.bpm) ELSE t.bpm END AS bpm, CASE WHEN {D.blank('t.key_tag')} THEN nullif(c.key, '') ELSE t.key_tag END AS key_tag, CASE WHEN {D.blank('t.genre')} THEN c.genre ELSE t.genre END AS genre, t.comment, c.path IS NOT NULL AS matched FROM tracks t LEFT JOIN collection c ON t.path = c.path"""
_SEARCHED = f"""SELECT track_id, length_s, lead <> '' AS hint, {D.search_words('key', 'lead')} AS words FROM (SELECT track_id, length_s, {D.match_key('wanted')} AS key, lead FROM (SELECT track_id, length_s, {D.search_title('title', 'path')} AS wanted, {D.lead('artist')} AS lead FROM tracks) t WHERE length(wanted) >= 3) u WHERE key <> ''"""
_LISTED = f"""SELECT recording_id, listed, length_ms, hint, CASE WHEN hint THEN {D.search_words('key', 'lead')} ELSE {D.search_words('key', "''")} END AS found FROM (SELECT recording_id, score AS listed, length_ms, {D.match_key('title')} AS key, {D.lead('artist')} AS lead FROM recordings) r CROSS JOIN (VALUES (false), (true)) h(hint) WHERE key <> ''"""
BY_TEXT = f"""SELECT track_id, arg_min(recording_id, n) AS recording_id, arg_min(score, n) AS score FROM (SELECT track_id, length_s, recording_id, length_ms, score, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, listed DESC, recording_id) AS n FROM (
 SELECT t.track_id, t.length_s, r.recording_id, r.listed, r.length_ms, len(list_intersect(t.words, r.found)) AS common, greatest(len(t.words), len(r.found)) AS most, (100 * len(list_intersect(t.words, r.found)) // greatest(len(t.words), len(r.found)))::INTEGER AS score FROM ({_SEARCHED}) t JOIN ({_LISTED}) r ON t.hint = r.hint AND list_has_any(t.words, r.found)) x WHERE 10 * common > 7 * most) y
 WHERE n <= 3 AND abs(length_ms / 1000e0 - length_s) <= 5 GROUP BY track_id"""
BY_FINGERPRINT = "SELECT track_id, recording_id, score FROM (SELECT t.track_id, r.recording_id, r.score, row_number() OVER (PARTITION BY t.track_id ORDER BY r.score DESC, recording_id) AS n FROM tracks t JOIN recordings r ON t.fingerprint = r.fingerprint WHERE r.score > 75) x WHERE n = 1"
FIRST_RELEASE = f"""SELECT recording_id, arg_min(y, ord) FILTER (y IS NOT NULL) AS year, arg_min(title, ord) FILTER (title IS NOT NULL) AS album,
 CASE WHEN min(ord) FILTER (y IS NOT NULL) IS NULL OR min(ord) FILTER (title IS NOT NULL) IS NULL OR min(ord) FILTER (label IS NOT NULL) <= greatest(min(ord) FILTER (y IS NOT NULL), min(ord) FILTER (title IS NOT NULL)) THEN arg_min(label, ord) FILTER (label IS NOT NULL) END AS label
 FROM (SELECT *, {D.year_of_date('date')} AS y FROM releases) r GROUP BY recording_id"""
_FOUND = f"""SELECT t.*, method, r.recording_id AS found_id, r.artist AS other_artist, r.title AS other_title, l.year AS other_year, l.album AS other_album, {D.genre_of_text('r.artist', 'r.title', 'l.album')} AS words
 FROM tracks t LEFT JOIN (SELECT track_id, recording_id, 'text' AS method FROM ({BY_TEXT}) a UNION ALL SELECT track_id, recording_id, 'fingerprint' FROM ({BY_FINGERPRINT}) b WHERE track_id NOT IN (SELECT track_id FROM ({BY_TEXT}) c)) f ON t.track_id = f.track_id
 LEFT JOIN recordings r ON f.recording_id = r.recording_id LEFT JOIN ({FIRST_RELEASE}) l ON r.recording_id = l.recording_id"""
ENRICHED = f"""SELECT track_id, method, outcome, CASE WHEN ok THEN {D.sanitize('other_artist')} END AS new_artist, CASE WHEN ok THEN {D.sanitize('other_title')} END AS new_title, CASE WHEN ok THEN {D.year('other_year')} END AS new_year, CASE WHEN ok THEN {D.sanitize('other_album')} END AS new_album,
 CASE WHEN ok THEN {D.genre_of_path('path', 'words')} END AS new_genre, CASE WHEN ok AND (bpm IS NULL OR NOT {D.number('bpm')}) THEN {D.lookup('words', rules.GENRE_BPM, "'120'")} END AS new_bpm, CASE WHEN found_id IS NOT NULL THEN other_year END AS found_year, CASE WHEN found_id IS NOT NULL THEN other_album END AS found_album
 FROM (SELECT *, outcome = 'accepted' AS ok FROM (SELECT *, CASE WHEN found_id IS NULL THEN 'unmatched' WHEN {D.gate('artist', 'title', "coalesce(nullif(tdrc, ''), tyer)", 'other_artist', 'other_title', 'other_year')} THEN 'accepted' ELSE 'rejected' END AS outcome FROM ({_FOUND}) f) g) h"""
ENERGY = "SELECT track_id, round(greatest(1e0, least(10e0, (least(max(tempo) / 130, 1.5e0) * 0.4e0 + least(avg(rms) * 1000, 2e0) * 0.4e0 + least(avg(centroid) / 2000e0, 1.5e0) * 0.2e0) * 5)), 1) AS energy FROM audio_frames GROUP BY track_id"
# Segments by the frames that they take in, one by one.
RATIOS = """SELECT track_id, beat_idx, t, bar, a.mean / (b.mean + 1e-10) AS ratio FROM (
 SELECT s.track_id, s.beat_idx, s.t_s AS t, s.bar, s.frame_idx AS start_idx, e.frame_idx AS end_idx, p.frame_idx AS before_idx FROM (SELECT q.*, f.frame_idx FROM asked q ASOF JOIN audio_frames f ON q.track_id = f.track_id AND q.t_s >= f.t_s) s
 JOIN (SELECT q.track_id, q.beat_idx, f.frame_idx FROM asked q ASOF JOIN audio_frames f ON q.track_id = f.track_id AND least(q.t8, q.last_s) >= f.t_s) e ON s.track_id = e.track_id AND s.beat_idx = e.beat_idx
 JOIN (SELECT q.track_id, q.beat_idx, f.frame_idx FROM asked q ASOF JOIN audio_frames f ON q.track_id = f.track_id AND greatest(0, q.t_s - q.bar) >= f.t_s) p ON s.track_id = p.track_id AND s.beat_idx = p.beat_idx) g,
 LATERAL (SELECT avg(mean_abs_mfcc) AS mean FROM audio_frames f WHERE f.track_id = g.track_id AND f.frame_idx >= start_idx AND f.frame_idx < end_idx) a,
 LATERAL (SELECT avg(mean_abs_mfcc) AS mean FROM audio_frames f WHERE f.track_id = g.track_id AND f.frame_idx >= before_idx AND f.frame_idx < start_idx) b"""
ASKED = """SELECT b.track_id, beat_idx, t_s, t8, bar, last_s FROM (SELECT *, lead(t_s, 8) OVER (PARTITION BY track_id ORDER BY beat_idx) AS t8 FROM beats) b JOIN (SELECT track_id, 4 * 60 / max(tempo) AS bar, max(t_s) AS last_s FROM audio_frames GROUP BY track_id) x ON b.track_id = x.track_id WHERE t8 IS NOT NULL AND beat_idx % 8 = 1"""
CUES = f"""WITH asked AS ({ASKED}), r AS (SELECT *, t > 5 AND coalesce(ratio > 1.4, false) AS change FROM ({RATIOS}) z),
 c AS (SELECT track_id, min(t) FILTER (change AND t > bar * 8) AS intro, list_sort(list(t) FILTER (change))[1:3] AS drops FROM r GROUP BY track_id),
 f AS (SELECT x.track_id, coalesce(intro, bar * 16) AS intro, coalesce(drops, []) AS drops, greatest(length - 16 * bar, length * 0.75) AS outro FROM (SELECT track_id, max(t_s) AS length, 4 * 60 / max(tempo) AS bar FROM audio_frames GROUP BY track_id) x LEFT JOIN c ON x.track_id = c.track_id)
 SELECT track_id, round(intro, 4) AS intro_end, array_to_string(list_transform(drops, lambda x: printf('%.1f', round(x, 1))), ',') AS drops, round(outro, 4) AS outro_start, array_to_string(list_transform(list_concat([0e0, intro], drops, [outro]), lambda x: printf('%.2f', round(x, 2))), ',') AS recommended FROM f"""
LOUDNESS = "SELECT track_id, round(-14e0 - (lufs + 20 * log10(0.9e0 / peak)), 4) AS gain_db, round(least(0.9e0 * pow(10e0, (-14e0 - (lufs + 20 * log10(0.9e0 / peak))) / 20), 0.99e0), 4) AS peak_after, 0.9e0 * pow(10e0, (-14e0 - (lufs + 20 * log10(0.9e0 / peak))) / 20) > 0.99 AS clips FROM loudness"


def _profiles() -> str:
    """Rows (key, camelot, rank, w) of the rotated profiles; w is a list."""
    made = []
    for rank, (weights, suffix) in enumerate(((rules.MAJOR, ""), (rules.MINOR, "m"))):
        made += [f"('{p}{suffix}', '{rules.CAMELOT[p + suffix]}', {12 * rank + i}, {[float(weights[(j - i) % 12]) for j in range(12)]}::DOUBLE[])" for i, p in enumerate(rules.PITCHES)]
    return f"(VALUES {', '.join(made)}) p(key, camelot, rank, w)"


KEY = f"""SELECT track_id, CASE WHEN flat THEN NULL ELSE arg_min(key, place) END AS key, CASE WHEN flat THEN NULL ELSE arg_min(camelot, place) END AS camelot FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, rank) AS place FROM (
 SELECT track_id, key, camelot, rank, bool_and(v = m) OVER (PARTITION BY track_id) AS flat, round(r, 9) AS r FROM (SELECT track_id, key, camelot, rank, min(x) AS v, max(x) AS m, corr(x, y) AS r FROM (
 SELECT track_id, key, camelot, rank, unnest(v) AS x, unnest(w) AS y FROM (SELECT vec_id % 50 AS track_id, [{', '.join(f'avg(abs(embedding[{j}]::DOUBLE))' for j in range(1, 13))}] AS v FROM embeddings GROUP BY 1) c CROSS JOIN {_profiles()}) u GROUP BY 1, 2, 3, 4) g) h) i GROUP BY track_id, flat"""
_OWN_ARTIST, _OWN_TITLE = D.or_name_part(D.clean("artist"), D.clean("title"), "path")
PLANNED = f"""SELECT track_id, path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_replace({D.file_name('a', 't', 'y')}, '\\.mp3$', '') AS stem FROM (SELECT track_id, path, {_OWN_ARTIST} AS a, {_OWN_TITLE} AS t, coalesce({D.year("coalesce(nullif(tdrc, ''), tyer)")}, '') AS y FROM tracks) x"""


_FIELDS = ", ".join(f"({n}, {D.lit(f)}, {D.lit(field)})" for n, (f, field) in enumerate(tags.FIELDS.items()))
_FRAME_ROWS = "SELECT track_id, frame_id, text FROM tag_frames WHERE (frame_id LIKE 'T%' OR frame_id LIKE 'COMM%') AND text IS NOT NULL AND text <> ''"
_YEARS = f"SELECT track_id, coalesce({D.year('tdrc')}, {D.year('tyer')}) AS year, {D.year('tdrc')} IS NULL AND {D.year('tyer')} IS NOT NULL AS migrated FROM (SELECT track_id, max(text) FILTER (frame_id = 'TDRC') AS tdrc, max(text) FILTER (frame_id = 'TYER') AS tyer FROM tag_frames GROUP BY track_id) y"
_CLEAN_ROWS = f"""SELECT f.track_id, f.frame_id, CASE WHEN f.frame_id IN ({', '.join(map(D.lit, rules.PEOPLE_FRAMES))}) THEN {D.people('text')} WHEN f.frame_id IN ({', '.join(map(D.lit, rules.FRAMES))}) THEN {D.sanitize('text')} WHEN f.frame_id LIKE 'COMM%' THEN {D.consolidated('text')} ELSE text END AS text
 FROM ({_FRAME_ROWS}) f JOIN ({_YEARS}) y ON f.track_id = y.track_id WHERE f.frame_id <> 'TDRC' AND NOT (f.frame_id = 'TYER' AND migrated) UNION ALL SELECT y.track_id, 'TDRC', year FROM ({_YEARS}) y JOIN (SELECT DISTINCT track_id FROM ({_FRAME_ROWS}) f) k ON y.track_id = k.track_id"""
_DIFF = f"""SELECT coalesce(a.track_id, b.track_id) AS track_id, coalesce(n, 99) AS n, coalesce(a.frame_id, b.frame_id) AS frame_id, CASE WHEN a.text IS NULL THEN 'Added ' WHEN b.text IS NULL THEN 'Removed ' ELSE 'Cleaned ' END || coalesce(field, coalesce(a.frame_id, b.frame_id)) AS said
 FROM ({_FRAME_ROWS}) a FULL JOIN (SELECT * FROM ({_CLEAN_ROWS}) c WHERE text IS NOT NULL) b ON a.track_id = b.track_id AND a.frame_id = b.frame_id LEFT JOIN (VALUES {_FIELDS}) d(n, frame, field) ON d.frame = coalesce(a.frame_id, b.frame_id) WHERE a.text IS DISTINCT FROM b.text"""
CHANGED = f"SELECT track_id, string_agg(said, '; ' ORDER BY n, frame_id) AS said FROM ({_DIFF}) x WHERE frame_id NOT LIKE 'COMM%' GROUP BY track_id"
TAG_MAPS = f"""SELECT o.track_id, original, cleaned, coalesce(said, '') AS changes FROM (SELECT track_id, string_agg(frame_id || '=' || text, ';' ORDER BY frame_id) AS original FROM ({_FRAME_ROWS}) f GROUP BY track_id) o
 LEFT JOIN (SELECT track_id, string_agg(frame_id || '=' || text, ';' ORDER BY frame_id) AS cleaned FROM ({_CLEAN_ROWS}) c WHERE text IS NOT NULL GROUP BY track_id) n ON o.track_id = n.track_id LEFT JOIN ({CHANGED}) d ON o.track_id = d.track_id"""
_QUALITY = f"'QUALITY: ' || floor(coalesce(bitrate_bps, 0) / 1000)::INTEGER || 'kbps, ' || cast(coalesce(sample_rate_hz / 1000e0, 0e0) AS varchar) || 'kHz, ' || CASE WHEN {HIGH} THEN 'HIGH' ELSE 'LOW' END"
_RATED = f"SELECT track_id, rated IS DISTINCT FROM comment AS rated, {D.consolidated('rated')} AS comment, coalesce(rated, '') <> '' AS had_comment FROM (SELECT *, {D.annotate('comment', 'quality', 'quality')} AS rated FROM (SELECT *, {_QUALITY} AS quality FROM tracks) q) r"


_JOINED = f"""SELECT t.track_id, t.path, t.mtime, floor(coalesce(t.bitrate_bps, 0) / 1000)::INTEGER AS kbps, coalesce(t.sample_rate_hz / 1000e0, 0e0) AS khz, {HIGH.replace('bitrate_bps', 't.bitrate_bps').replace('sample_rate_hz', 't.sample_rate_hz')} AS is_high,
 coalesce(new_artist, {D.people('t.artist')}) AS artist_, coalesce(new_title, {D.sanitize('t.title')}) AS title_, coalesce(new_album, {D.sanitize('t.album')}) AS album, coalesce(new_year, {D.year('t.tdrc')}, {D.year('t.tyer')}) AS year, coalesce(new_genre, {D.sanitize('c.genre')}) AS genre,
 new_bpm IS NOT NULL AND (c.bpm IS NULL OR NOT {D.number('c.bpm')}) AS set_bpm, CASE WHEN new_bpm IS NOT NULL AND (c.bpm IS NULL OR NOT {D.number('c.bpm')}) THEN new_bpm ELSE c.bpm END AS bpm, coalesce(k.key, c.key_tag) AS key_tag, k.key AS found_key, camelot, energy, intro_end, drops, outro_start, gain_db, c.matched AS in_collection, method, outcome, found_year, found_album, outcome = 'accepted' AS enhanced,
 w.comment AS comment_, w.rated, w.had_comment, d.said AS cleaned_said
 FROM (SELECT * FROM tracks WHERE NOT EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)) t JOIN ({_RATED}) w ON t.track_id = w.track_id LEFT JOIN ({CHANGED}) d ON t.track_id = d.track_id
 JOIN ({COLLECTED}) c ON t.track_id = c.track_id JOIN ({ENRICHED}) e ON t.track_id = e.track_id LEFT JOIN ({KEY}) k ON t.track_id = k.track_id LEFT JOIN ({ENERGY}) n ON t.track_id = n.track_id LEFT JOIN ({CUES}) q ON t.track_id = q.track_id LEFT JOIN ({LOUDNESS}) o ON t.track_id = o.track_id"""
_ARTIST, _TITLE = D.or_name_part("artist_", "title_", "path")
_SAID = "comment_"
for _marker, _line in library.comment_lines(library.Options(), D):
    _SAID = D.annotate(_SAID, _marker, _line)
_PLACED = f"""SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_replace({D.file_name('artist', 'title', f"coalesce({D.year_of_date('year')}, '')")}, '\\.mp3$', '') AS stem FROM (SELECT *, {_ARTIST} AS artist, {_TITLE} AS title, {_SAID} AS comment FROM ({_JOINED}) j) k"""


def named(planned: str, held: str) -> str:
    """track_id, name of the rows planned (track_id, path, folder, stem), beside files (folder, file) that hold their names: the free numbers of each stem in order."""
    number = r"^(.*) \(([1-9][0-9]{0,8})\)$"
    return f"""SELECT w.track_id, w.folder || '/' || w.stem || CASE WHEN i > 0 THEN ' (' || i || ')' ELSE '' END || '.mp3' AS out_path FROM (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY path) AS n FROM ({planned}) p) w
 JOIN (SELECT folder, stem, i, row_number() OVER (PARTITION BY folder, stem ORDER BY i) AS n FROM (SELECT p.folder, p.stem, unnest(range(0, p.c + coalesce(h.c, 0) + 1)) AS i FROM (SELECT folder, stem, count(*) AS c FROM ({planned}) p GROUP BY 1, 2) p LEFT JOIN (SELECT folder, count(*) AS c FROM (SELECT folder, file FROM ({held}) h UNION SELECT folder, stem FROM ({planned}) p) u GROUP BY folder) h ON p.folder = h.folder) x
 WHERE NOT EXISTS (SELECT 1 FROM (SELECT folder, file AS stem, 0 AS k FROM ({held}) h UNION SELECT folder, regexp_extract(file, '{number}', 1), regexp_extract(file, '{number}', 2)::INTEGER FROM (SELECT folder, file FROM ({held}) h UNION SELECT folder, stem FROM ({planned}) p) u WHERE regexp_matches(file, '{number}')) t WHERE t.folder = x.folder AND t.stem = x.stem AND t.k = x.i)) f
 ON w.folder = f.folder AND w.stem = f.stem AND w.n = f.n"""


def of_path(table: str) -> str:
    return f"SELECT regexp_replace(path, '/[^/]*$', '') AS folder, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.mp3$', '', 'i') AS file FROM ({table}) o"


_HELD = f"{of_path('SELECT path FROM placed WHERE NOT enhanced')} UNION {of_path('SELECT out_path AS path FROM ledger WHERE out_path IS NOT NULL')}"
_NUMBERED = f"""WITH placed AS ({_PLACED}), names AS ({named('SELECT track_id, path, folder, stem FROM placed WHERE enhanced', _HELD)})
 SELECT p.*, coalesce(n.out_path, p.path) AS out_path FROM placed p LEFT JOIN names n ON p.track_id = n.track_id"""
PROCESSED = f"""SELECT *, CASE WHEN out_path <> path THEN 'renamed' ELSE 'kept' END AS action, concat_ws('; ', 'Quality analyzed: ' || kbps || 'kbps @ ' || cast(khz AS varchar) || 'kHz', CASE WHEN rated THEN 'Added quality comment' END, cleaned_said, CASE WHEN had_comment THEN CASE WHEN comment_ IS NULL THEN 'Removed comments' ELSE 'Consolidated comments' END END,
 CASE WHEN in_collection THEN 'Applied collection metadata' END, CASE WHEN enhanced THEN 'Enhanced from catalogue' END, 'Detected key: ' || found_key, 'Detected cue points: Intro: ' || printf('%.4f', intro_end) || 's, Outro: ' || printf('%.4f', outro_start) || 's',
 'Energy rating: ' || printf('%.1f', energy) || '/10', CASE WHEN gain_db IS NOT NULL THEN 'Normalized loudness to -14.0 LUFS' END, CASE WHEN out_path <> path THEN 'Renamed to: ' || regexp_replace(out_path, '^.*/', '') ELSE 'Kept original filename' END) AS changes FROM ({_NUMBERED}) r"""
#: As PROCESSED, with all cues told, and with numbers for files that would stay where an earlier run put another one.
_STAYS = """SELECT track_id, path, folder, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.mp3$', '', 'i') AS stem FROM placed WHERE NOT enhanced AND path IN (SELECT out_path FROM ledger WHERE out_path IS NOT NULL)"""
_ALL_NUMBERED = f"""WITH placed AS ({_PLACED.replace('outro_start, gain_db', 'outro_start, recommended, gain_db')}), names AS ({named('SELECT track_id, path, folder, stem FROM placed WHERE enhanced UNION ALL ' + _STAYS, _HELD)})
 SELECT p.*, coalesce(CASE WHEN enhanced THEN n.out_path ELSE regexp_replace(n.out_path, '\\.mp3$', '') || regexp_extract(p.path, '(\\.mp3)?$', 0, 'i') END, p.path) AS out_path FROM placed p LEFT JOIN names n ON p.track_id = n.track_id"""
_OUTRO = "', Outro: ' || printf('%.4f', outro_start) || 's'"
_CUED = "".join(f" || CASE WHEN {c} <> '' THEN ', {c.title()}: ' || replace({c}, ',', 's, ') || 's' ELSE '' END" for c in ("drops", "recommended"))
PROCESSED_WHOLE = PROCESSED.replace(_NUMBERED, _ALL_NUMBERED).replace("'s" + _OUTRO[1:], "'s" + _OUTRO[1:] + _CUED)
_REGIONS = SimpleNamespace(**{n: getattr(rules, n) for n in dir(rules) if n.isupper()} | {"PROMO_PATTERNS": [*rules.PROMO_PATTERNS, *(rf"(?i)\b{r}\b" for r in ("africa", "america", "asia", "europe", "middle east"))]})
_LINES = "SELECT doc_id AS track_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents"
_WORDS = ", ".join(f"({n}, {D.lit(w)}, {D.lit(g)})" for n, (w, g) in enumerate((w, g) for g, own in rules.GENRE_WORDS for w in own))
_KEYED = f"SELECT track_id, path, size_bytes, fingerprint, {KEYS} FROM tracks"
GROUPS = f"""SELECT row_number() OVER (ORDER BY k, group_key) AS group_no, kind, group_key, similarity, n FROM (SELECT 1 AS k, 'exact_match' AS kind, artist || '|||' || title AS group_key, 1e0 AS similarity, count(*) AS n FROM ({_KEYED}) t GROUP BY artist, title HAVING count(*) > 1
 UNION ALL SELECT 3, 'audio_match', fingerprint, 1e0, count(*) FROM ({_KEYED}) t GROUP BY fingerprint HAVING count(*) > 1 AND count(DISTINCT artist || chr(0) || title) > 1) g"""
ORACLE: dict[str, tuple[str, tuple[str, ...]]] = {name: (f"SELECT track_id, {', '.join(f'{e(D)} AS {n}' for n, e in columns)} FROM tracks", ("tracks",)) for name, columns in COLUMNS.items()} | {
    "clean_by_rules": (f"SELECT track_id, {Text(spark=False, lists=_REGIONS).clean('title')} AS title FROM ({_LINES}) l", ()),
    "genre_by_rules": (f"SELECT track_id, coalesce(arg_min(genre, priority), 'Indian') AS genre FROM ({_LINES}) l LEFT JOIN (SELECT * FROM (VALUES {_WORDS}) w(priority, word, genre) UNION ALL SELECT 100 + n_nationkey, lower(n_name), 'World Music' FROM nation) r ON contains(lower(title), word) GROUP BY track_id", ()),
    "dup_exact": (f"SELECT artist, title, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, min(track_id) AS first_id FROM (SELECT track_id, size_bytes, lower(trim({D.clean('artist')})) AS artist, lower(coalesce(nullif(trim({D.clean('title')}), ''), cast(track_id AS varchar))) AS title FROM tracks WHERE {HIGH}) t GROUP BY 1, 2 HAVING count(*) > 1", ("tracks",)),
    "dup_similar_lev": ("""WITH u AS (SELECT artist, title, min(path) AS path, arg_min(track_id, path) AS id FROM (SELECT track_id, path, lower(trim(coalesce(artist, ''))) AS artist, regexp_replace(lower(trim(title)), '[^a-z0-9 ]', '', 'g') AS title FROM tracks) t WHERE artist <> '' AND trim(title) <> '' GROUP BY artist, title)
 SELECT l.id AS a_id, r.id AS b_id, levenshtein(l.title, r.title)::INTEGER AS distance FROM u l JOIN u r ON l.artist = r.artist AND l.path < r.path
 WHERE levenshtein(l.title, r.title) <= floor(0.2 * (length(l.title) + length(r.title)) + 1e-9)""", ("tracks",)),
    "dup_audio": (f"SELECT fingerprint, count(*) AS n, min(track_id) AS first_id, max(track_id) AS last_id FROM (SELECT track_id, fingerprint, {KEYS} FROM tracks) t GROUP BY fingerprint HAVING count(*) > 1 AND count(DISTINCT artist || chr(0) || title) > 1", ("tracks",)),
    "dup_groups": (GROUPS, ("tracks",)),
    "dup_group_members": (f"SELECT group_no, kind, similarity, n, track_id, path, size_bytes // 1024 AS kb FROM ({GROUPS}) g JOIN ({_KEYED}) t ON g.group_key = CASE WHEN kind = 'exact_match' THEN artist || '|||' || title ELSE fingerprint END", ("tracks",)),
    "quality_report": (f"SELECT track_id, floor(bitrate_bps / 1000)::INTEGER AS kbps, round(coalesce(sample_rate_hz / 1000e0, 0), 3) AS khz, cast(floor(length_s)::BIGINT // 60 AS varchar) || ':' || lpad(cast(floor(length_s)::BIGINT % 60 AS varchar), 2, '0') AS length, {HIGH} AS is_high, CASE WHEN {HIGH} THEN 'HIGH' ELSE 'LOW' END AS rating FROM tracks", ("tracks",)),
    "high_quality": (f"SELECT track_id, path FROM tracks WHERE {HIGH}", ("tracks",)),
    "strict_partition": (f"SELECT {HIGH} AS is_high, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM tracks GROUP BY 1", ("tracks",)),
    "low_quality_list": (f"SELECT path, floor(bitrate_bps / 1000)::INTEGER AS kbps, round(coalesce(sample_rate_hz / 1000e0, 0), 3) AS khz, round(length_s, 3) AS length_s FROM tracks WHERE NOT ({HIGH})", ("tracks",)),
    "missing_score": (f"SELECT track_id, path, ({SCORE})::INTEGER AS missing_score FROM ({scores()}) s", ("tracks",)),
    "completion_pct": (f"SELECT track_id, round((55 - ({SCORE})) * 100e0 / 55, 6) AS completion FROM ({scores()}) s", ("tracks",)),
    "gap_by_field": (" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (no_{f}) AS n_missing FROM ({scores()}) s" for f in rules.FIELD_WEIGHTS), ("tracks",)),
    "priority_top20": (f"SELECT track_id, path, ({SCORE})::INTEGER AS missing_score, round((55 - ({SCORE})) * 100e0 / 55, 6) AS completion FROM ({scores()}) s ORDER BY 3 DESC, path LIMIT 20", ("tracks",)),
    "clean_tags": (LOG, ("tag_frames",)),
    "tag_snapshot": ("SELECT track_id, count(*) AS n_frames, string_agg(frame_id || '=' || text, ';' ORDER BY frame_id || '=' || text) AS tags FROM tag_frames WHERE text <> '' GROUP BY track_id", ("tag_frames",)),
    "comment_consolidate": (f"SELECT track_id, CASE WHEN contains(lower(text), 'itunes') THEN NULL ELSE nullif(array_to_string({D.comment_lines('text')}, chr(10)), '') END AS comment, 1::BIGINT AS n_frames FROM tag_frames WHERE frame_id LIKE 'COMM%' AND text IS NOT NULL", ("tag_frames",)),
    "changes_report": (f"SELECT track_id, count(*) AS n_changes, count(*) FILTER (action = 'removed') AS n_removed, string_agg(said, '; ' ORDER BY said) AS changes FROM (SELECT *, frame_id || ': ' || old_text || ' -> ' || coalesce(new_text, '(removed)') AS said FROM ({LOG}) x) l GROUP BY track_id", ("tag_frames",)),
    "year_repair": (f"SELECT track_id, coalesce({D.year('tdrc')}, {D.year('tyer')}) AS year, CASE WHEN {D.year('tdrc')} IS NOT NULL AND {D.year('tdrc')} <> tdrc THEN 'parsed' WHEN {D.year('tdrc')} IS NULL AND {D.year('tyer')} IS NOT NULL THEN 'migrated' WHEN {D.year('tdrc')} IS NULL AND NOT {D.blank('tdrc')} THEN 'dropped' ELSE 'kept' END AS action FROM tracks", ("tracks",)),
    "annotate_comments": ("SELECT track_id, CASE WHEN contains(coalesce(comment, ''), 'Energy:') THEN comment ELSE concat_ws(chr(10), nullif(comment, ''), 'Energy: ' || printf('%.1f', (track_id % 100) / 10e0) || '/10') END AS comment FROM tracks", ("tracks",)),
    "incremental_new": (f"SELECT path, mtime FROM tracks WHERE NOT EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)", ("tracks", "ledger")),
    "incremental_skipped": (f"SELECT path, mtime FROM tracks WHERE EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)", ("tracks", "ledger")),
    "ledger_latest": (LATEST, ("ledger",)),
    "collection_enrich": (COLLECTED, ("tracks", "collection")),
    "identify_text": (BY_TEXT, ("tracks", "recordings")),
    "identify_fingerprint": (BY_FINGERPRINT, ("tracks", "recordings")),
    "release_first": (FIRST_RELEASE, ("releases",)),
    "catalog_enrich": (ENRICHED, ("tracks", "recordings", "releases")),
    "match_gate": (f"SELECT t.track_id, r.recording_id, {D.gate('t.artist', 't.title', 'tdrc', 'r.artist', 'r.title', repr('2001'))} AS accepted FROM tracks t JOIN recordings r ON t.fingerprint = r.fingerprint", ("tracks", "recordings")),
    "dynamic_range": ("SELECT track_id, round(20 * log10(max(peak_abs) / (avg(rms) + 1e-10)), 4) AS db, round(max(peak_abs) / (sqrt(sum(sum_sq) / sum(n)) + 1e-10), 4) AS crest, CASE WHEN 20 * log10(max(peak_abs) / (avg(rms) + 1e-10)) > 14 THEN 'Excellent' WHEN 20 * log10(max(peak_abs) / (avg(rms) + 1e-10)) > 10 THEN 'Good' WHEN 20 * log10(max(peak_abs) / (avg(rms) + 1e-10)) > 6 THEN 'Fair' ELSE 'Poor' END AS rating FROM audio_frames GROUP BY track_id", ("audio_frames",)),
    "energy_rating": (ENERGY, ("audio_frames",)),
    "cue_points": (CUES, ("audio_frames", "beats")),
    "tag_maps": (TAG_MAPS, ("tag_frames",)),
    "gap_by_genre": ("SELECT genre, field, grouping(genre, field)::INTEGER AS level, count(*) AS n_tracks, count(*) FILTER (missing) AS n_missing FROM (" + " UNION ALL ".join(f"SELECT coalesce(nullif(trim(genre), ''), '(none)') AS genre, '{f}' AS field, no_{f} AS missing FROM ({scores()}) s" for f in rules.FIELD_WEIGHTS) + ") x GROUP BY CUBE (genre, field)", ("tracks",)),
    "musical_key": (KEY, ()),
    "cue_change_ratio": (f"WITH asked AS ({ASKED}) SELECT track_id, beat_idx, round(ratio, 6) AS ratio FROM ({RATIOS}) z WHERE ratio IS NOT NULL", ("audio_frames", "beats")),
    "loudness_plan": (LOUDNESS, ("loudness",)),
    "output_plan": (f"WITH high AS (SELECT * FROM ({PLANNED}) p WHERE track_id IN (SELECT track_id FROM tracks WHERE {HIGH})), n AS ({named('SELECT * FROM high', 'SELECT NULL::VARCHAR AS folder, NULL::VARCHAR AS file WHERE false')}) SELECT t.track_id, t.path, n.out_path, n.out_path IS NOT NULL AS moved, CASE WHEN n.out_path IS NULL THEN 'skipped' WHEN n.out_path <> t.path THEN 'renamed' ELSE 'kept' END AS action FROM tracks t LEFT JOIN n ON t.track_id = n.track_id", ("tracks",)),
    "name_collisions": (f"WITH p AS (SELECT track_id, path, '/out' AS folder, stem FROM ({PLANNED}) p) SELECT track_id, regexp_replace(out_path, '^/out/', '') AS name FROM ({named('SELECT * FROM p WHERE track_id % 2 = 1', 'SELECT folder, stem AS file FROM p WHERE track_id % 2 = 0')}) n", ("tracks",)),
    "file_url": ("SELECT track_id, path, 'file://localhost' || replace(url_encode(path), '%2F', '/') AS url FROM tracks", ("tracks",)),
    "collection_import": ("SELECT path, coalesce(title, '') AS title, coalesce(artist, '') AS artist, coalesce(album, '') AS album, coalesce(genre, '') AS genre, coalesce(comment, '') AS comment, coalesce(key_tag, '') AS key, try_cast(bpm AS DOUBLE) AS bpm, 0 AS rating, 0 AS play_count, 0 AS n_cues FROM tracks", ("tracks",)),
    "collection_export": (f"""SELECT row_number() OVER (ORDER BY path) AS "_TrackID", coalesce(title, '') AS "_Name", coalesce(artist, '') AS "_Artist", coalesce(album, '') AS "_Album", coalesce(genre, '') AS "_Genre", coalesce(bpm, '') AS "_AverageBpm", coalesce(key_tag, '') AS "_Tonality",
 coalesce(comment, '') AS "_Comments", coalesce({D.year("coalesce(tdrc, tyer, '')")}, '') AS "_Year", cast(size_bytes AS varchar) AS "_FileSize", floor(length_s)::BIGINT AS "_TotalTime", 'file://localhost' || replace(url_encode(path), '%2F', '/') AS "_Location" FROM tracks""", ("tracks",)),
    "collection_playlist": ('SELECT row_number() OVER (ORDER BY path) AS "_Key" FROM tracks', ("tracks",)),
    "dup_exact_raw": (f"SELECT artist, title, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, min(track_id) AS first_id FROM (SELECT size_bytes, track_id, {KEYS} FROM tracks) t GROUP BY 1, 2 HAVING count(*) > 1", ("tracks",)),
    "dup_exact_normalized": (f"SELECT {D.match_key('artist')} AS artist, {D.match_key(TITLE_OR_STEM)} AS title, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, min(track_id) AS first_id FROM tracks GROUP BY 1, 2 HAVING count(*) > 1", ("tracks",)),
    "dup_members": (f"SELECT artist, title, track_id, path, size_bytes // 1024 AS kb FROM (SELECT *, count(*) OVER (PARTITION BY artist, title) AS n FROM (SELECT track_id, path, size_bytes, {KEYS} FROM tracks) t) x WHERE n > 1", ("tracks",)),
    "people_tokens": (f"SELECT track_id, array_to_string(list_sort({D.tokens('artist')}), '|') AS tokens FROM tracks", ("tracks",)),
    "quality_line": (f"SELECT track_id, {_QUALITY} AS line FROM tracks WHERE bitrate_bps IS NOT NULL", ("tracks",)),
    "process_library": (f"SELECT track_id, path, kbps, is_high, artist, title, album, year, genre, bpm, key_tag, comment, found_key, energy, intro_end, outro_start, gain_db, in_collection, method, outcome, out_path, action, changes FROM ({{RESULT}}) r".replace("{RESULT}", PROCESSED_WHOLE), JOB),
    "run_stats": ("SELECT count(*) AS processed, " + ", ".join(f"sum(n_{n})::BIGINT AS {n}" for n in library.COUNTERS) + " FROM (SELECT " + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS n_{n}" for n, c in library.COUNTERS.items()) + f" FROM ({PROCESSED}) r UNION ALL SELECT " + ", ".join({"high_quality": f"CASE WHEN {HIGH} THEN 1 ELSE 0 END", "low_quality": f"CASE WHEN {HIGH} THEN 0 ELSE 1 END"}.get(n, "0") for n in library.COUNTERS) + f" FROM tracks WHERE EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)) x", JOB),
    "match_rates": (f"""SELECT round(100e0 * hits / nullif(hits + failures, 0), 6) AS success_rate, round(100e0 * years / nullif(hits, 0), 6) AS year_rate, round(100e0 * albums / nullif(hits, 0), 6) AS album_rate, round(100e0 * hits / nullif(hits, 0), 6) AS genre_rate, round(100e0 * bpms / nullif(hits, 0), 6) AS bpm_rate
 FROM (SELECT count(method) AS hits, count(*) FILTER (outcome <> 'accepted') AS failures, count(found_year) AS years, count(found_album) AS albums, count(*) FILTER (set_bpm) AS bpms FROM ({PROCESSED}) r) x""", JOB),
    "low_quality_report": (f"SELECT r.path, r.kbps, round(r.khz, 3) AS khz, cast(floor(length_s)::BIGINT // 60 AS varchar) || ':' || lpad(cast(floor(length_s)::BIGINT % 60 AS varchar), 2, '0') AS length FROM ({PROCESSED}) r JOIN tracks USING (track_id) WHERE NOT r.is_high", JOB),
    "rename_report": (f"SELECT track_id, CASE WHEN action = 'renamed' THEN 'renamed' ELSE 'review' END AS kind, path, out_path, enhanced FROM ({PROCESSED}) r WHERE action = 'renamed' OR outcome = 'unmatched'", JOB),
    "ledger_append": (f"SELECT path, mtime, {HIGH} AS is_high_quality FROM tracks WHERE NOT EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)", ("tracks", "ledger")),
    "session_summary": (f"SELECT p.*, (SELECT count(*) FROM (SELECT 1 FROM (SELECT {KEYS} FROM tracks) k GROUP BY artist, title HAVING count(*) > 1) g) AS duplicate_groups FROM (SELECT count(*) AS processed, count(*) FILTER ({HIGH}) AS high_quality, count(*) FILTER (NOT ({HIGH})) AS low_quality FROM tracks WHERE NOT EXISTS (SELECT 1 FROM ({LATEST}) l WHERE l.path = tracks.path AND tracks.mtime <= l.mtime)) p", ("tracks", "ledger")),
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(query, *views) for name, (query, views) in ORACLE.items()}

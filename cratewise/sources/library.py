"""Library tables, derived from the given documents, events, parts and embeddings by SQL that both engines run."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "base": """SELECT doc_id, lower(source) AS src, lang, n_chars, md5(text) AS fp, trim(left(split_part(text, chr(10), 1), 40)) AS base FROM documents""",
    "tracks": """SELECT doc_id AS track_id,
  '/music/' || coalesce(lang,'xx') || '/' || src || '/' || cast(doc_id AS varchar(20)) || '.mp3' AS path,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 6 = 0 THEN src || ' & guest - djmaza' ELSE src END AS artist,
  base || CASE doc_id % 8 WHEN 0 THEN ' (Official)' WHEN 1 THEN ' (Remix)' WHEN 2 THEN ' [Tamil]'
     WHEN 3 THEN ' 320kbps' WHEN 4 THEN ' - www.djmaza.com' WHEN 5 THEN ' (2001)' ELSE '' END AS title,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Album ' || cast(doc_id % 50 AS varchar(20)) END AS album,
  CASE doc_id % 7 WHEN 0 THEN '2020-05-03' WHEN 1 THEN '1999' WHEN 2 THEN 'abc 2001 def' WHEN 3 THEN '2050' WHEN 4 THEN '1899' WHEN 5 THEN '' END AS tdrc,
  CASE WHEN doc_id % 3 = 0 THEN '2005' END AS tyer,
  CASE doc_id % 5 WHEN 0 THEN 'Tamil' WHEN 1 THEN 'r&b' WHEN 2 THEN 'hip-hop songspk' WHEN 3 THEN '' END AS genre,
  CASE doc_id % 4 WHEN 0 THEN '128' WHEN 1 THEN 'fast' WHEN 2 THEN '' END AS bpm,
  CASE doc_id % 3 WHEN 0 THEN 'Am' WHEN 1 THEN ' ' END AS key_tag,
  CASE doc_id % 5 WHEN 0 THEN 'Energy: 7.5/10' || chr(10) || 'visit www.songspk.com'
     WHEN 1 THEN 'QUALITY: 320kbps, 44.1kHz, HIGH' WHEN 2 THEN 'iTunes 0001' WHEN 3 THEN 'follow us on djmaza' END AS comment,
  CASE doc_id % 4 WHEN 0 THEN 320000 WHEN 1 THEN 319999 WHEN 2 THEN 256000 ELSE 321000 END AS bitrate_bps,
  CASE doc_id % 5 WHEN 0 THEN 48000 WHEN 1 THEN 32000 WHEN 2 THEN NULL ELSE 44100 END AS sample_rate_hz,
  n_chars * 0.027e0 AS length_s, n_chars * 1024 AS size_bytes, 1.7e9 + doc_id AS mtime, fp AS fingerprint FROM base""",
    "ledger": """SELECT path, mtime + CASE WHEN (track_id + run) % 8 = 0 THEN 10 ELSE -10 END AS mtime, 1.71e9 + run AS last_processed, track_id % 3 = run AS is_high_quality,
  regexp_replace(path, '/[^/]*$', '') || '/' || artist || CASE WHEN run = 0 THEN '' ELSE ' (1)' END || '.mp3' AS out_path
  FROM tracks CROSS JOIN (VALUES (0),(4)) r(run) WHERE track_id % 4 = 0 AND (run = 0 OR track_id % 3 = 0)""",
    "recordings": """SELECT doc_id AS recording_id, src AS artist, base AS title,
  n_chars * 27 + (doc_id % 11) * 1000 AS length_ms, 60 + doc_id % 41 AS score, fp AS fingerprint FROM base WHERE doc_id % 3 = 0""",
    "releases": """SELECT recording_id, ord,
  CASE (recording_id + ord) % 4 WHEN 1 THEN '1999-05-01' WHEN 2 THEN '2050' WHEN 3 THEN '2003' END AS date,
  CASE WHEN (recording_id + ord) % 3 = 0 THEN NULL ELSE 'Album ' || cast(recording_id % 50 AS varchar(20)) END AS title,
  CASE WHEN ord = 1 THEN 'Label' END AS label FROM recordings CROSS JOIN (VALUES (0),(1),(2)) r(ord)""",
    "collection": """SELECT path, track_id AS ordinal, 100e0 + track_id % 60 AS bpm,
  CASE WHEN track_id % 4 = 0 THEN 'Gm' ELSE '' END AS key, 'Dance' AS genre FROM tracks WHERE track_id % 2 = 0""",
    "tag_frames": """SELECT track_id, frame_id, 0 AS ord, CASE frame_id WHEN 'TIT2' THEN title WHEN 'TPE1' THEN artist WHEN 'TALB' THEN album WHEN 'TCON' THEN genre
     WHEN 'TDRC' THEN tdrc WHEN 'TYER' THEN tyer WHEN 'TBPM' THEN bpm WHEN 'TKEY' THEN key_tag ELSE comment END AS text
  FROM tracks CROSS JOIN (VALUES ('TIT2'),('TPE1'),('TALB'),('TCON'),('TDRC'),('TYER'),('TBPM'),('TKEY'),('COMM::eng')) f(frame_id)""",
    "audio_frames": """SELECT user_id AS track_id, i AS frame_idx, i * 0.5e0 AS t_s, value / 500e0 AS rms,
  least(1e0, value / 250e0) AS peak_abs, value * value / 250000e0 AS sum_sq, 1 AS n, value * 20 AS centroid, value AS mean_abs_mfcc, 90e0 + user_id % 7 * 10 AS tempo
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS i FROM events) e""",
    "beats": """SELECT track_id, beat_idx, t_s FROM (SELECT track_id, frame_idx AS beat_idx, frame_idx * 60e0 / tempo AS t_s, max(t_s) OVER (PARTITION BY track_id) AS last_s FROM audio_frames) b
  WHERE t_s <= last_s""",
    "loudness": "SELECT p_partkey AS track_id, -5e0 - p_size * 0.4e0 AS lufs, 0.3e0 + (p_partkey % 70) / 100e0 AS peak FROM part",
}
NEEDS = {"tracks": ["base"], "ledger": ["base", "tracks"], "recordings": ["base"], "releases": ["base", "recordings"], "collection": ["base", "tracks"], "tag_frames": ["base", "tracks"], "beats": ["audio_frames"]}
GIVEN = ["documents", "events", "part", "embeddings"]


def with_views(query: str, *views: str) -> str:
    """``query`` after the definitions of the views it reads."""
    names = list(dict.fromkeys(x for v in views for x in [*NEEDS.get(v, []), v]))
    if not names:
        return query
    own = query.lstrip()
    rest = f",\n{own[5:]}" if own.startswith("WITH ") else f"\n{query}"
    return f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in names)}{rest}"


def exploded(query: str) -> str:
    """For Spark: rows times a list of values by ``explode``, not by a cross join."""
    values = lambda m: f"LATERAL VIEW explode(array({m[1].replace('(', '').replace(')', '')})) {m[2]} AS {m[3]}"
    return re.sub(r"CROSS JOIN \(VALUES ([^ ]+)\) (\w)\((\w+)\)", values, query)


def sql(spark: SparkSession, sf_dir: str, query: str, *views: str) -> DataFrame:
    """``query`` over the tables of a folder. These have names of their own for as long as the query is analysed, so a session's views stay."""
    text, names = exploded(with_views(query, *views)), []
    for table in GIVEN:
        if re.search(rf"\bFROM {table}\b", text):
            names.append(f"{table}_{uuid.uuid4().hex}")
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createTempView(names[-1])
            text = re.sub(rf"\bFROM {table}\b", f"FROM {names[-1]}", text)
    try:
        return spark.sql(text)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}", name)

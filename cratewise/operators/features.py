"""Ratings of tracks from audio features, many rows a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.functions import rules
from cratewise.sources.shared import by_shuffle


def dynamic_range(frames: DataFrame) -> DataFrame:
    """track_id, db, crest, rating from peaks, mean loudness and mean square."""
    sums = frames.groupBy("track_id").agg(F.max("peak_abs").alias("peak"), F.avg("rms").alias("rms"), (F.sum("sum_sq") / F.sum("n")).alias("square"))
    db = 20 * F.log10(F.col("peak") / (F.col("rms") + 1e-10))
    rating = F.when(F.col("db") > 14, "Excellent").when(F.col("db") > 10, "Good").when(F.col("db") > 6, "Fair").otherwise("Poor")
    return sums.withColumn("db", db).select("track_id", F.round("db", 4).alias("db"), F.round(F.col("peak") / (F.sqrt("square") + 1e-10), 4).alias("crest"), rating.alias("rating"))


def energy(frames: DataFrame) -> DataFrame:
    """track_id, energy (1 to 10) from tempo, loudness and brightness."""
    sums = frames.groupBy("track_id").agg(F.avg("rms").alias("rms"), F.avg("centroid").alias("centroid"), F.max("tempo").alias("tempo"))
    score = (F.least(F.col("tempo") / 130.0, F.lit(1.5)) * 0.4 + F.least(F.col("rms") * 1000, F.lit(2.0)) * 0.4 + F.least(F.col("centroid") / 2000.0, F.lit(1.5)) * 0.2) * 5.0
    return sums.select("track_id", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)), 1).alias("energy"))


def loudness_plan(loudness: DataFrame, target: float = -14.0) -> DataFrame:
    """track_id, gain_db, peak_after, clips: what bringing each track to the target would do."""
    normal = F.col("lufs") + 20 * F.log10(F.lit(0.9) / F.col("peak"))
    gain = F.lit(target) - normal
    linear = F.pow(F.lit(10.0), gain / 20)
    return loudness.select("track_id", F.round(gain, 4).alias("gain_db"), F.round(F.least(linear * 0.9, F.lit(0.99)), 4).alias("peak_after"), (linear * 0.9 > 0.99).alias("clips"))


def chroma_frames(embeddings: DataFrame) -> DataFrame:
    """track_id, frame_idx, chroma (12 values), from the given vectors."""
    return embeddings.select((F.col("vec_id") % 50).alias("track_id"), F.col("vec_id").alias("frame_idx"), F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))


def musical_key(chroma: DataFrame) -> DataFrame:
    """track_id, key, camelot: the best correlated of 24 rotated profiles, major and then low pitches first where they tie; null where all is flat."""
    means = chroma.groupBy("track_id").agg(F.array(*(F.avg(F.col("chroma")[i]) for i in range(12))).alias("v"))
    profiles = []
    for rank, (values, suffix) in enumerate(((rules.MAJOR, ""), (rules.MINOR, "m"))):
        mean = sum(values) / 12
        norm = sum((x - mean) ** 2 for x in values) ** 0.5
        for i, pitch in enumerate(rules.PITCHES):
            rotated = [(values[(j - i) % 12] - mean) / norm for j in range(12)]
            profiles.append((pitch + suffix, rank * 12 + i, rotated))
    centre = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / 12
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("centre")) * (x - F.col("centre"))))
    rows = means.withColumn("centre", centre).withColumn("spread", spread)
    dot = lambda w: sum(((F.col("v")[j] - F.col("centre")) * w[j] for j in range(12)), F.lit(0.0))
    scored = F.array(*(F.struct(F.round(dot(w) / F.col("spread"), 9).alias("r"), F.lit(-rank).alias("rank"), F.lit(key).alias("key"), F.lit(rules.CAMELOT[key]).alias("camelot")) for key, rank, w in profiles))
    best = rows.withColumn("best", F.when(F.col("spread") > 0, F.array_max(scored)))
    return best.select("track_id", "best.key", "best.camelot")


def segment_means(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """track_id, beat_idx, t_s, bar, length, ratio: at every second bar's first beat, the mean from it to the beat eight on against that of the
    bar (four beats of the track's tempo) before it. Null where either has no frame.

    A segment goes from the frame in which it begins to the one in which it ends, which is left out, like the last frame of all. Its mean comes
    from running sums, looked up at the three times by one sort of frames and times together.
    """
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    before = F.coalesce(F.sum("mean_abs_mfcc").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = frames.select("track_id", F.col("t_s").alias("at"), F.struct(F.col("frame_idx").cast("long").alias("idx"), before.alias("sum")).alias("frame"))
    facts = frames.groupBy("track_id").agg(F.max("t_s").alias("length"), F.max("tempo").alias("tempo"), F.max_by(F.struct(F.col("frame_idx").cast("long").alias("idx"), "t_s"), "frame_idx").alias("last"))
    ahead = F.lead("t_s", 8).over(Window.partitionBy("track_id").orderBy("beat_idx"))
    asked = beats.withColumn("end", ahead).where("end IS NOT NULL AND beat_idx % 8 = 1").join(by_shuffle(facts), "track_id").withColumn("bar", 4 * 60 / F.col("tempo"))
    times = [F.struct(F.lit(name).alias("what"), at.alias("at")) for name, at in (("start", F.col("t_s")), ("end", F.least("end", "last.t_s")), ("before", F.greatest(F.lit(0.0), F.col("t_s") - F.col("bar"))))]
    wanted = asked.select("track_id", F.struct("beat_idx", "t_s", "bar", "length").alias("beat"), F.explode(F.array(*times)).alias("x")).select("track_id", "beat", "x.*")
    both = sums.unionByName(wanted, allowMissingColumns=True)
    found = both.withColumn("frame", F.last("frame", ignorenulls=True).over(Window.partitionBy("track_id").orderBy("at", F.col("what").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    at = {name: F.max(F.when(F.col("what") == name, F.col("frame"))) for name in ("start", "end", "before")}
    rows = found.where("what IS NOT NULL").groupBy("track_id", "beat").agg(*(x.alias(n) for n, x in at.items()))
    mean = lambda a, b: F.when(F.col(f"{b}.idx") > F.col(f"{a}.idx"), (F.col(f"{b}.sum") - F.col(f"{a}.sum")) / (F.col(f"{b}.idx") - F.col(f"{a}.idx")))
    return rows.select("track_id", "beat.*", (mean("start", "end") / (mean("before", "start") + 1e-10)).alias("ratio"))


def cue_ratios(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """track_id, beat_idx, ratio where there is one."""
    return segment_means(frames, beats).where("ratio IS NOT NULL").select("track_id", "beat_idx", F.round("ratio", 6).alias("ratio"))


def cue_points(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """track_id, intro_end, drops, outro_start, recommended: changes after five seconds whose ratio passes 1.4. The intro ends at the first one
    after eight bars, else after 16; the outro is 16 bars, a quarter of the track at most; drops are the first three changes, and
    the start, the intro's end, the drops and the outro's start are the recommended cues."""
    change = (F.col("t_s") > 5.0) & (F.col("ratio") > 1.4)
    found = segment_means(frames, beats).groupBy("track_id").agg(
        F.min(F.when(change & (F.col("t_s") > F.col("bar") * 8), F.col("t_s"))).alias("intro"), F.slice(F.array_sort(F.collect_list(F.when(change, F.col("t_s")))), 1, 3).alias("drops")
    )
    facts = frames.groupBy("track_id").agg(F.max("t_s").alias("length"), (4 * 60 / F.max("tempo")).alias("bar")).join(by_shuffle(found), "track_id", "left")
    intro, outro = F.coalesce("intro", F.col("bar") * 16), F.greatest(F.col("length") - 16 * F.col("bar"), F.col("length") * 0.75)
    drops = F.coalesce("drops", F.array().cast("array<double>"))
    shown = lambda values, places: F.array_join(F.transform(values, lambda x: F.format_string(f"%.{places}f", F.round(x, places))), ",")
    recommended = F.concat(F.array(F.lit(0.0), intro), drops, F.array(outro))
    return facts.select("track_id", F.round(intro, 4).alias("intro_end"), shown(drops, 1).alias("drops"), F.round(outro, 4).alias("outro_start"), shown(recommended, 2).alias("recommended"))

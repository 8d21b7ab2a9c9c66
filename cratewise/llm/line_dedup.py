"""Removal of repeated line runs by a suffix array over line ids.

Lines that occur once can't be part of a repeated run, so only the others are sorted. Prefix doubling gives
each line start, for each power of two, the rank of the run of so many lines that starts there: distinct
pairs of ranks are sorted by ranges, and their place in that order is the next rank; a stretch of repeated
lines that ends earlier sorts first. The last rank covers the longest minimal run, so line starts sorted by it
are the suffix array as deep as it is needed. Each start of a run of ``min_words`` words is then compared with
the one before it in that array: two ranks, of the first and of the last lines of a run, name it, so equal names tell that the
longest common prefix reaches over the whole run. Neighbours that it reaches are an interval: the run's occurrences.
All but the first, by (doc_id, text hash, line), are later copies, and their lines are deleted. A stretch of
repeated lines without the start of a run has no part in any. Longer repeated runs lose all lines that such runs cover; last lines from which fewer than
``min_words`` words are left of the repeat stay, as in the query's SQL.

Defined cases: a null text stays null. Lines end at newlines only; words are parted by spaces, tabs, form feeds and
carriage returns; blank lines belong to a run but hold no words, and a run doesn't start with one. A run may repeat within a document. Rows equal in id and text
count as one document and get the same result. Documents that lose all lines stay, with an empty text. Long
documents and frequent lines are sorted by range and joined, never gathered in one place as lists, but for a
document's own deleted runs. An empty table gives an empty result. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.common import carried, materialise

MIN_WORDS = 20
DOC = ["doc_id", "h", "n"]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, at, a, b, words: each line with its place, its 128-bit id and its words."""
    line = lambda l, i: F.struct(i.alias("at"), F.xxhash64(l).alias("a"), F.xxhash64(F.lit(1), l).alias("b"), F.regexp_count(l, F.lit(r"[^ \t\n\f\r]+")).alias("words"))
    return docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), F.explode(F.transform(F.split("text", "\n", -1), line)).alias("x")).select(*DOC, "x.*")


def places(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with their rank as ``name``: their place in a sort by ranges."""
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "line-ranks")


def equal(columns: list[str]) -> list[Column]:
    """Columns of l and r that agree, nulls too."""
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]


def suffix_array(runs: DataFrame) -> DataFrame:
    """``runs`` in the order of their rank, equal ones by place: ``part``, a range of that order, and ``pos``, which rises along all ranges."""
    order = ["rank", *DOC, "at"]
    ordered = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "line-suffixes")


def intervals(runs: DataFrame) -> DataFrame:
    """``runs`` with interval: where in the suffix array its neighbours with a common prefix over the whole run begin.

    Neighbours are compared within ranges; one row for each range then tells whether an interval goes on from the range before.
    """
    run, along = F.struct("lines", "head", "tail"), Window.partitionBy("part").orderBy("pos")
    before = F.lag(run).over(along)
    array = suffix_array(runs).withColumn("starts", F.when(before.isNotNull() & (before != run), F.col("pos")))
    each = array.groupBy("part").agg(F.min_by(run, "pos").alias("low"), F.max_by(run, "pos").alias("high"), F.min("pos").alias("pos"), F.max("starts").alias("last"))
    ranges = Window.orderBy("part")
    new = ~F.lag("high").over(ranges).eqNullSafe(F.col("low"))
    each = each.withColumn("own", F.when(new, F.col("pos")))
    gone_on = F.max(F.coalesce("last", "own")).over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("part", F.coalesce("own", gone_on).alias("led"))
    started = F.max("starts").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return array.withColumn("interval", started).join(each, "part").withColumn("interval", F.coalesce("interval", "led")).drop("part", "pos", "starts", "led", "rank")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, n, start, end: places of the lines (0-based, end inclusive) of minimal runs that occurred before."""
    in_order = Window.partitionBy(*DOC).orderBy("at")
    own = lines(docs)
    often = own.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    rows = materialise(own.join(places(often, ["a", "b"], "r0"), ["a", "b"]).drop("a", "b").distinct(), "line-r0")
    block = Window.partitionBy(*DOC, "block")
    rows = rows.withColumn("block", F.col("at") - F.row_number().over(in_order))
    before = F.sum("words").over(block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    rows = rows.withColumn("before", before.cast("long"))
    reach = block.orderBy("before").rangeBetween(0, min_words - 1)
    rows = rows.withColumn("last", F.max("at").over(reach)).withColumn("enough", F.max(F.col("before") + F.col("words")).over(reach) - F.col("before") >= min_words)
    rows = rows.withColumn("lines", F.when((F.col("words") > 0) & F.col("enough"), F.col("last") - F.col("at") + 1))
    # a block where no run starts has no part in any, and goes
    rows = rows.withColumn("runs", F.max("lines").over(block)).where("runs IS NOT NULL")
    rows = materialise(rows.select(*DOC, "block", "at", "lines", "r0"), "line-runs")
    longest = rows.agg(F.max("lines")).first()[0]
    if longest is None:
        return rows.select(*DOC, F.col("at").alias("start"), F.col("at").alias("end")).limit(0)
    level, parts = 0, []
    while True:
        size = 1 << level
        here = F.col(f"r{level}")
        # A run of size to 2 * size - 1 lines is named by the first and the last size lines of it, which overlap.
        ends = rows.select(*DOC, F.col("at").alias("tail_at"), here.alias("tail"))
        runs = rows.where(F.col("lines").between(size, 2 * size - 1)).select(*DOC, "at", "lines", here.alias("head"), (F.col("at") + F.col("lines") - size).alias("tail_at"))
        parts.append(runs.alias("l").join(ends.alias("r"), equal([*DOC, "tail_at"])).select("l.*", "r.tail").drop("tail_at"))
        if size >= longest:
            break
        level += 1
        pairs = rows.withColumn("next", F.lead(f"r{level - 1}", size).over(block.orderBy("at")))
        ranks = places(pairs.select(f"r{level - 1}", "next").distinct(), [f"r{level - 1}", "next"], f"r{level}")
        rows = materialise(pairs.alias("l").join(ranks.alias("r"), equal([f"r{level - 1}", "next"])).select(*(f"l.{c}" for c in (*DOC, "block", "at", "lines")), f"r.r{level}"), "line-level")
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionAll(part)
    ranked = rows.where("lines IS NOT NULL").select(*DOC, "at", F.col(f"r{level}").alias("rank"))
    found = intervals(runs.alias("l").join(ranked.alias("r"), equal([*DOC, "at"])).select("l.*", "r.rank")).withColumn("place", F.struct(*DOC, "at"))
    first = found.groupBy("interval").agg(F.min("place").alias("first"), F.count("*").alias("members")).where("members > 1")
    again = found.join(first, "interval").where("place != first")
    return again.select(*DOC, F.col("at").alias("start"), (F.col("at") + F.col("lines") - 1).cast("int").alias("end"))


def maximal_runs(copies: DataFrame) -> DataFrame:
    """key, gone: the overlapping or adjoining copies of each document as disjoint runs (start, end)."""
    ordered = Window.partitionBy(*DOC).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = copies.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(F.struct(*DOC).alias("key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))


def remove(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """``docs`` without later copies of repeated runs.

    With ``report``: doc_id, text, n_lines, n_deleted, runs (``start:lines`` of each maximal one, comma-joined).
    """
    runs = maximal_runs(later_copies(docs.select("doc_id", "text"), min_words))
    own_text = F.col("row.text")
    key = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64(own_text).alias("h"), F.length(own_text).alias("n"))
    joined = carried(docs.select("doc_id", "text") if report else docs).withColumn("own", key).join(runs, F.col("own").eqNullSafe(F.col("key")), "left")

    def kept(lines: Column) -> Column:
        """What stands before, between and after the runs."""

        def gap(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1)["end"] + 1)
            return F.slice(lines, start + 1, F.when(k == F.size("gone"), F.size(lines)).otherwise(F.get("gone", k)["start"]) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), gap)), "\n")

    left = F.transform(F.array(F.split(own_text, "\n", -1)), kept)[0]
    text = F.when(F.col("gone").isNull(), own_text).otherwise(left)
    if not report:
        return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
    lines = F.when(own_text.isNull(), 0).otherwise(F.regexp_count(own_text, F.lit("\n")) + 1)
    return joined.select(
        "row.doc_id", lines.cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"] + 1), F.lit(0)).alias("n_deleted"),
        F.coalesce(F.array_join(F.transform("gone", lambda r: F.concat_ws(":", r["start"], r["end"] - r["start"] + 1)), ","), F.lit("")).alias("runs"), text.alias("text"),
    )

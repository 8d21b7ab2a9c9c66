"""Benchmark decontamination.

Windows of normalised benchmark words are a hash set that is broadcast if it is small (MOST_WINDOWS), and
joined by shuffle beyond that. Every window of words of every document is looked up by its words, so a hit
is verified. A word inside any occurrence of a window is hit.

Defined cases: null texts have no words. Items without words have no windows; items with fewer words than a
window are one window of their own length. A window of several items counts for each. Repeated items (equal
ids and texts) are one. Rows equal in id and text become one row of the report for each copy, with equal
values. An empty table gives an empty result; texts of any length are read whole. Other columns are ignored by ``report`` and kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import broadcast_if_small, carried, materialise

WINDOW = 10
#: About 150 bytes each.
MOST_WINDOWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def windows(own: Column, sizes: list[int], spread: Column) -> Column:
    """A marker (0, number of words, a text that is no window), then (at, size, window) of every window of these sizes.

    ``own`` is bound once, by an outer transform, as an inner lambda would compute it again for each element. ``spread`` deals
    the markers out over the tasks of a join by windows, as a null would send all of them to one.
    """

    def marker(w: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("at"), F.size(w).alias("size"), F.concat(F.lit(" "), spread.cast("string")).alias("window")))

    def of(size: int, w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(w, i, size), " ").alias("window")))

    return F.flatten(F.transform(F.array(own), lambda w: F.concat(marker(w), *(of(size, w) for size in sizes))))


def benchmark_windows(items: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """(window, window_id, item_ids), written once so that its ids stay, and the sizes that occur: at most ``window`` of them."""
    own = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = own.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window"), size.alias("size"))
    sizes = sorted(r["size"] for r in each.select("size").distinct().collect())
    table = each.groupBy("window").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window_id", F.monotonically_increasing_id())
    return materialise(table, "benchmark-windows"), sizes


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For each distinct (doc_id, text): its key, n_words, spans (word places, 1-based, of occurrences) and window_ids; and the table of windows.

    Each document sends one marker row with its word count along, so documents without hits stay. A hit carries its window's id
    only, however many items have that window.
    """
    table, sizes = benchmark_windows(items, window)
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), words(F.col("text")).alias("w"))
    rows = own.select("doc_id", "h", "n", F.explode(windows(F.col("w"), sizes, F.xxhash64("doc_id", "h"))).alias("x")).select("doc_id", "h", "n", "x.*")
    found = rows.join(broadcast_if_small(table.select("window", "window_id"), MOST_WINDOWS), "window", "left").where("at = 0 OR window_id IS NOT NULL")
    span = F.when(F.col("at") > 0, F.struct("at", "size"))
    grouped = found.groupBy("doc_id", "h", "n").agg(
        F.max(F.when(F.col("at") == 0, F.col("size"))).alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("window_id").alias("window_ids")
    )
    return grouped, table


def items_of(found: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, h, n, item_ids of what ``hits`` found, but for documents without hits."""
    each = found.select("doc_id", "h", "n", F.explode("window_ids").alias("window_id"))
    owners = table.select("window_id", F.explode("item_ids").alias("item_id"))
    return each.join(broadcast_if_small(owners, MOST_WINDOWS), "window_id").groupBy("doc_id", "h", "n").agg(F.collect_set("item_id").alias("item_ids"))


def merged(spans: Column) -> Column:
    """Sorted spans (at, size) as disjoint ones (a, b), b exclusive."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(done: Column, s: Column) -> Column:
        last, end = F.element_at(done, -1), s["at"] + s["size"]
        return F.when((F.size(done) > 0) & (s["at"] <= last["b"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], end).alias("b"))))).otherwise(
            F.concat(done, F.array(F.struct(s["at"].alias("a"), end.alias("b"))))
        )

    return F.when(F.size(spans) == 0, empty).otherwise(F.aggregate(spans, empty, add))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    found, table = hits(docs, items, window)
    found = materialise(found, "window-hits")
    same = F.expr("o.doc_id <=> m.doc_id AND o.h = m.h AND o.n <=> m.n")
    joined = found.alias("o").join(items_of(found, table).alias("m"), same, "left").select("o.*", F.coalesce("m.item_ids", F.array()).alias("item_ids"))
    own = joined.withColumn("hit", merged(F.col("spans"))).select(
        "doc_id", "h", "n", F.col("n_words").cast("long"),
        F.aggregate("hit", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"]).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
    )
    copies = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).groupBy("doc_id", "h", "n").count()
    out = own.withColumn("contaminated", F.col("n_hit") > 0)
    more = copies.where("count > 1").select("doc_id", "h", "n", (F.col("count") - 1).cast("int").alias("again"))
    repeated = out.alias("o").join(more.alias("m"), same).select("o.*", F.explode(F.sequence(F.lit(1), F.col("again"))).alias("i")).drop("i")
    return out.unionAll(repeated).drop("h", "n")


def _key() -> Column:
    return F.struct(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.xxhash64("row.text").alias("h"))


def remove_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no window hits; all columns stay."""
    bad = hits(docs, items, window)[0].where(F.size("spans") > 0).select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h").alias("bad"))
    rows = carried(docs).withColumn("own", _key())
    return rows.join(bad, F.col("own") == F.col("bad"), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the hit words; what stands between words stays."""
    bad = hits(docs, items, window)[0].where(F.size("spans") > 0).select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h").alias("bad"), merged(F.col("spans")).alias("hit"))
    bad = bad.groupBy("bad").agg(F.first("hit").alias("hit"))
    joined = carried(docs).withColumn("own", _key()).join(bad, F.col("own") == F.col("bad"), "left")
    upper = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    own, between = F.regexp_extract_all("row.text", F.lit(upper), F.lit(0)), F.split("row.text", upper, -1)

    def flags(k: Column) -> Column:
        """Of the words after the span before, and of the span."""
        span = F.get("hit", k)
        return F.concat(F.array_repeat(F.lit(False), span["a"] - F.when(k == 0, F.lit(1)).otherwise(F.get("hit", k - 1)["b"])), F.array_repeat(F.lit(True), span["b"] - span["a"]))

    gone = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hit") - 1), flags))
    kept = F.transform(F.array(F.struct(own.alias("w"), between.alias("s"), gone.alias("gone"))), lambda x: F.concat(x["s"][0], F.array_join(
        F.transform(x["w"], lambda w, i: F.concat(F.when(F.coalesce(F.get(x["gone"], i), F.lit(False)), F.lit("")).otherwise(w), x["s"][i + 1])), "")))[0]
    return joined.select(F.col("row").withField("text", F.when(F.col("hit").isNull(), F.col("row.text")).otherwise(kept)).alias("row")).select("row.*")

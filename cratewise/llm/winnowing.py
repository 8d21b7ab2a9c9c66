"""Document fingerprints by winnowing.

Every run of GRAM bytes of a text (UTF-8) is hashed, and of each WINDOW neighbouring hashes the smallest is
kept with its position, the rightmost of equal ones. So two texts that share GRAM + WINDOW - 1 bytes in a row
share a fingerprint at least. A text with fewer hashes is one window, one shorter than GRAM is one gram, and
an empty text keeps nothing. A null text counts as empty.

All work is done by array functions on a text's own bytes: 32 bits of hash and 31 of position are one long,
so a window's minimum is the rightmost smallest hash. ``transform`` over an array of one binds a computed
value to a name; without that it would be computed again for each element.

An empty table gives an empty result; repeated rows get a row each; a text of any length is one array. Equal texts have equal fingerprints. The likeness of two is the share of common hashes, 1 for two empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.common import texts

GRAM = 12
WINDOW = 16
POSITION_BITS = 31
#: Documents of a bucket of neighbours. Buckets are ranges of ids, found by approximate quantiles; they grow beyond so many.
BUCKET_DOCS = 1_000
MOST_BUCKETS = 100_000

LONGS = "array<bigint>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hashes(data: Column, gram: int) -> Column:
    """One long for each run of ``gram`` bytes: 32 bits of its hash, then its position turned round, so that later ones are smaller."""
    last = F.lit((1 << POSITION_BITS) - 1)

    def one(b: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(F.substring(b, i, F.lit(gram))).bitwiseAND(F.lit((1 << 32) - 1)), POSITION_BITS).bitwiseOR(last - i)

    none = F.array().cast(LONGS)
    return bound(
        data,
        lambda b: F.when(F.length(b) >= gram, F.transform(F.sequence(F.lit(1), F.length(b) - gram + 1), lambda i: one(b, i)))
        .when(F.length(b) > 0, F.array(one(b, F.lit(1))))
        .otherwise(none),
    )


def minima(values: Column, window: int) -> Column:
    """The minimum of the ``window`` values from each place on (of fewer at the end), by doubling spans."""
    span = 1
    steps = []
    while span < window:
        steps.append(min(span, window - span))
        span += steps[-1]

    def widen(v: Column, left: list[int]) -> Column:
        return bound(F.transform(v, lambda x, i: F.least(x, F.get(v, i + left[0]))), lambda m: widen(m, left[1:])) if left else v

    return bound(values, lambda v: widen(v, steps))


def chosen(values: Column, window: int) -> Column:
    """The minimum of each window, each choice once, in order of position."""
    return bound(minima(values, window), lambda m: F.filter(m, lambda x, i: (i <= F.greatest(F.size(m) - window, F.lit(0))) & ((i == 0) | (x != F.get(m, i - 1)))))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen longs of a text."""
    return chosen(hashes(F.encode(text, "UTF-8"), gram), window)


def position(value: Column) -> Column:
    """1-based byte position of a chosen long."""
    return F.lit((1 << POSITION_BITS) - 1) - value.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def hash_of(value: Column) -> Column:
    return F.shiftright(value, POSITION_BITS)


def within(choices: Column, windows: Column, window: int) -> Column:
    """The choices that the first ``windows`` windows make.

    A choice that isn't greater than the one before was chosen as soon as a window reached it; a greater one
    only when the one before had left.
    """
    since = lambda x, i: F.when(i == 0, F.lit(1)).when(hash_of(x) <= hash_of(F.get(choices, i - 1)), F.greatest(position(x) - window + 1, F.lit(1))).otherwise(position(F.get(choices, i - 1)) + 1)
    return F.filter(choices, lambda x, i: since(x, i) <= windows)


def spliced(own: Column, head: Column, other: Column, tail: Column, gram: int, window: int) -> Column:
    """Distinct hashes of the winnowing of ``head`` + ``tail`` (binary), where ``own`` are the choices of a text that
    starts with head and ``other`` those of one that starts with tail.

    Windows wholly within either keep their choices; only those across the seam are computed.
    """
    reach = gram + window - 2
    far = 4 * (gram + window)
    seam = F.concat(F.when(F.length(head) > reach, F.substring(head, F.length(head) - reach + 1, F.lit(reach))).otherwise(head), F.substring(tail, F.lit(1), F.lit(reach)))
    inside = lambda choices, data: bound(choices, lambda c: within(c, F.length(data) - gram - window + 2, window))
    joined = F.concat(inside(own, head), chosen(hashes(seam, gram), window), inside(other, tail))
    whole = chosen(hashes(F.concat(head, tail), gram), window)
    return distinct_hashes(F.when(F.length(head) + F.length(tail) < far, whole).otherwise(joined))


def distinct_hashes(choices: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(choices, hash_of)))


def shown(values: Column) -> Column:
    """Sorted hashes as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def place(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by halving: a step for each binary digit of their number."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def narrow(table: Column, at: Column, left: list[int]) -> Column:
        if not left:
            return at
        return bound(F.when(F.get(table, at + (left[0] - 1)) <= value, at + left[0]).otherwise(at), lambda found: narrow(table, found, left[1:]))

    return bound(F.split(F.lit(",".join(map(str, cuts))), ",").cast(LONGS), lambda table: narrow(table, F.lit(0), steps)) if cuts else F.lit(0)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, guard): rows in buckets of neighbouring ids, each with a guard, the first row of the next one.

    So a window over a bucket sees the next row of each of its own rows; the last bucket's guard is the first row of all.
    There are at most MOST_BUCKETS buckets, so their table is broadcast and put in order as one.
    """
    n = docs.count()
    share = max(1, min(MOST_BUCKETS, n // BUCKET_DOCS))
    key = F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(key, [k / share for k in range(1, share)], max(10_000, 10 * share)).alias("c")).first()["c"] if share > 1 else None
    own = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(place(sorted(set(cuts or [])), key)).alias("own"))
    firsts = own.groupBy("own").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    one = Window.orderBy("own")
    firsts = firsts.select("own", "first", "nulls", F.coalesce(F.lag("own").over(one), F.max("own").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    start = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("first")) & (F.col("nulls") == 0))
    copies = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guard")), F.when(F.coalesce(start, F.lit(False)), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guard"))))
    return own.join(F.broadcast(firsts), "own").select("doc_id", "text", F.explode(F.array_compact(copies)).alias("x")).select("doc_id", "text", "x.bucket", "x.guard")


def compare_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last half is the next document's first part.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and positions: the 1-based bytes where
    the chosen runs of the text start, comma-joined. The next document is that of the next row in ascending doc_id, text; null ids
    come first, and the first row follows the last.
    """
    order = Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")
    rows = with_next(texts(docs)).repartition("bucket").withColumn("choices", winnow(F.col("text"), gram, window))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_choices", F.lead("choices").over(order)).where("NOT guard")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("head", F.encode(F.substring(F.col("text"), F.lit(1), F.length("text") - half), "UTF-8")).withColumn("tail", F.encode(F.substring(F.col("next_text"), F.lit(1), half), "UTF-8"))
    edited = F.transform(
        F.array(F.struct("choices", "head", "next_choices", "tail")), lambda x: spliced(x["choices"], x["head"], x["next_choices"], x["tail"], gram, window)
    )[0]
    sets = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        F.array_join(F.transform("choices", lambda x: position(x).cast("string")), ",").alias("positions"),
        F.transform(F.array(F.struct(distinct_hashes(F.col("choices")).alias("own"), edited.alias("edited"), distinct_hashes(F.col("next_choices")).alias("next"))), lambda s: F.struct(
            shown(s["own"]).alias("fingerprint"), shown(s["edited"]).alias("edited_fingerprint"),
            likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], s["next"]).alias("near_next"),
        ))[0].alias("x"),
    )
    return sets.select("doc_id", "n_chars", "edited_sha256", "x.*", "positions")

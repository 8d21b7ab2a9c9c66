"""Variants of spelling: words one edit apart, grouped under the most frequent one.

Dense prefix-suffix tiling: words of a tile are rows of a padded matrix of code points, and all pairs of its rows are compared at once,
column by column, from the front and from the back. Two different words are one inserted, deleted or replaced
code point apart exactly if their common prefix and suffix together reach the longer length minus one.

Tiles: of the longer word's length L one side is whole: either the first or the last floor(L / 2) code points are common.
So words meet by (side, L, that half), as words of length L or of L - 1. Small groups share a tile; a group of more than
TILE words is dealt out in blocks by a hash, and each pair of blocks is a tile. A pair counts on the front side if its common
prefix is that long, else on the back side, and in the tile of its two blocks, so it counts once.

Defined cases: a null or empty text has no words; a null id is an empty one in the hash; repeated rows count each. Of near words as frequent the first in
code point order is the form. An empty table gives an empty result. Texts are read whole, and words of any length are compared whole.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import materialise, texts

#: Maximal runs, after A-Z are lower-cased.
RUN = "a-zÀ-ÿ"
#: Every so many-th run of a document, by a hash, loses a code point.
MISTAKES = 97
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: A form is so many times as frequent as its variant.
TIMES = 2
#: Rows of a tile, about, and letters of its matrix at most, but for one row.
TILE, LETTERS = 128, 1 << 20
#: Distinct words that a task holds before it sends their counts.
HELD = 400_000


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: all words, with one code point taken out of some runs. Words are counted in each task before any is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(f"[{RUN}]{{{LEAST_LENGTH},}}"), Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for doc_id, text in zip(*(batch.column(c).slice(start, 200).to_pylist() for c in (0, 1)), strict=True):
                    seed = crc32(f"{doc_id}:".encode())
                    for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                        h = crc32(word.encode(), seed)
                        if h % MISTAKES == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                if len(total) > HELD:
                    yield counted()
                    total.clear()
        yield counted()

    keyed = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counts = keyed.mapInArrow(run, "word string, n long").where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_TIMES)


def tiles(words: DataFrame) -> DataFrame:
    """key, low, high, block, side, length, word, n: the words of each tile (of two blocks of a key, or of one)."""
    size = F.length("word")
    meets = []
    for extra in (0, 1):
        length = size + extra
        half = F.floor(length / 2).cast("int")
        for side, part in enumerate((F.substring("word", F.lit(1), half), F.substring("word", size - half + 1, half))):
            meets.append(F.struct(F.lit(side).alias("side"), length.alias("length"), F.xxhash64(F.lit(side), length, part).alias("key")))
    rows = words.select("word", "n", F.explode(F.array(*meets)).alias("m")).select("word", "n", "m.*")
    most = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(LETTERS / F.max("length"))))
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"), F.count("*").alias("members")).where("members > 1").drop("members")
    dealt = rows.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "side", "length", "word", "n")


def common(letters: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Length of the common prefix of all pairs of rows that ``may`` names."""
    same, total = may.copy(), np.zeros(may.shape, np.int32)
    for column in letters.T:
        same &= column[:, None] == column
        if not same.any():
            break
        total += same
    return total


def compare(words: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray, length: np.ndarray, block: np.ndarray, crossing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with near words, the number of these, and the row of the most frequent one (ties: the first in code point order).

    ``crossing``: whether the group is of two blocks, whose words then meet those of the other one only."""
    size = np.char.str_len(words)
    longer = np.maximum(size[:, None], size)
    may = (group[:, None] == group) & (longer == length[:, None]) & (~crossing[:, None] | (block[:, None] != block)) & (longer - np.minimum(size[:, None], size) <= 1)
    np.fill_diagonal(may, False)
    front = common(words.view(np.uint32).reshape(len(words), -1), may)
    turned = np.array([w[::-1] for w in words.tolist()], words.dtype)
    back = common(turned.view(np.uint32).reshape(len(words), -1), may)
    near = may & (front + back >= longer - 1) & ((front >= longer // 2) == (side[:, None] == 0))
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -n))] = np.arange(len(words))
    count = near.sum(axis=1)
    at = np.flatnonzero(count)
    return at, count[at], np.where(near[at], rank, len(words)).argmin(axis=1)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (n, word): of the words that have near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in packed(batches):
            key, low, high, block, side, length, n = (tile.column(c).to_numpy() for c in ("key", "low", "high", "block", "side", "length", "n"))
            spelled = np.array(tile.column("word").to_pylist())
            group = np.cumsum(np.concatenate([[0], changes(key, low, high)]))
            at, count, best = compare(spelled, n, group, side, length, block, low != high)
            if at.size:
                yield pa.RecordBatch.from_arrays([pa.array(spelled[at].tolist()), pa.array(count), pa.array(n[best]), pa.array(spelled[best].tolist())], ["word", "n_near", "best_n", "best"])

    dealt = tiles(words).repartition("key", "low", "high").sortWithinPartitions("length", "key", "low", "high")
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("form"))).alias("best"))


def changes(*columns: np.ndarray) -> np.ndarray:
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of sorted rows, packed up to about TILE rows."""
    rest = None
    for batch in batches:
        rest = pa.concat_batches([rest, batch]) if rest is not None and rest.num_rows else batch
        starts = np.flatnonzero(changes(*(rest.column(c).to_numpy() for c in ("key", "low", "high")))) + 1
        rest = yield from cut(rest, starts)
    if rest is not None and rest.num_rows:
        yield rest


def cut(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tiles of the groups that end within ``rows``; gives back what is left."""
    done = 0
    width = np.maximum.accumulate(rows.column("length").to_numpy()) if rows.num_rows else np.zeros(0, int)
    while starts.size:
        most = done + max(1, min(TILE, LETTERS // int(width[min(done + TILE, rows.num_rows) - 1])))
        k = max(0, int(np.searchsorted(starts, most, "right")) - 1)
        yield rows.slice(done, int(starts[k]) - done)
        done, starts = int(starts[k]), starts[k + 1 :]
    return rows.slice(done)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead at last, by jumping twice as far in each round."""
    known = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = materialise(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if known.where("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word: the most frequent near word, if that is frequent enough, and where forms lead."""
    words = materialise(count_words(docs), "spelling-words")
    near = near_words(words)
    likely = -F.col("best.minus_n") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.form")).alias("form"), F.when(likely, -F.col("best.minus_n")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    found = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

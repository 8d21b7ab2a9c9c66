"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of byte n-grams within words and one of whole words. All counts
below the highest order are shared: an n-gram that a class hasn't seen falls back to how many contexts its
ending continues in either class, and a word to its share of both. A document's length-normalised
log-likelihood ratios make the score, through a logistic curve fitted on other labelled rows: the whole ratio, what its
words have beyond each of LEVELS, and the largest of a word; so a few telling expressions count in a long text too.

Spark counts the words of all training documents, copies once, and from them the n-grams; none is dropped, those
seen once neither. Every fourth fold of the training rows sets the curve, from at most CURVE_ROWS rows, under counts
without that fold; scores are by the counts of all training rows. Up to MOST_HELD n-grams and words (16 bytes each)
are broadcast (``Held``), so texts are read once and nothing is shuffled. Beyond, counts, backoff and ratios stay tables
(``Tables``): the ratios of the CACHED_WORDS most frequent words are broadcast, those of all other words are joined by
shuffle. Both give the same scores.

Where no rows of both classes are labelled, every score is 0.5.
A null or empty text scores as a document without evidence; repeated rows each get their score; an empty table gives an
empty result; words are split at white space, of any length, and texts are read whole; columns other than doc_id and
text are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import broadcast_if_small, fold, labelled, logistic, materialise, texts

ORDER = 5
#: Words are looked up by a hash with this bit; n-grams have 56 bits.
WORD = 1 << 62
DISCOUNT = 0.75
CURVE_ROWS = 20_000
#: n-grams and words that are broadcast; beyond, they are joined by shuffle.
MOST_HELD = 4_000_000
#: Words whose ratios are broadcast; this costs time, never a count.
CACHED_WORDS = 200_000
#: Uncached words in so many documents meet their counts in parts, as one key would hold them all; and how many such words are broadcast to tell.
HEAVY, HEAVY_PARTS, MOST_OFTEN = 20_000, 64, 100_000
#: n-grams with at most three bytes of a word are in many words; their ratios are dealt over so many keys.
SALTS, SHORT = 16, 1 << 32
#: Counts without the fold of the curve, and of all training rows.
PARTS = ("own", "all")
#: Labels of up to so many documents are broadcast (16 bytes each); beyond, Spark joins by shuffle.
MOST_LABELS = 2_000_000
CACHE_WORDS = 300_000
LEVELS = (0.0, 1.0, 2.0, 3.0)
#: Of n-grams and of words: the length-normalised ratio, what is beyond each level, and the largest of a word.
FEATURES = 2 * (len(LEVELS) + 2)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words, packed into integers, and the number of each word's. A space leads and ends a word."""
    pad = b"\0" * (ORDER - 2)
    data = [pad + b" " + w.encode() + b" " for w in words]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    sizes = np.array([len(d) for d in data], np.int64)
    packed = np.zeros(max(0, flat.size - ORDER + 1), np.int64)
    for n in range(ORDER):
        packed = (packed << 8) | flat[n : n + packed.size]
    ends = np.cumsum(sizes)
    keep = np.ones(packed.size, bool)
    for n in range(1, ORDER):  # not across two words
        at = ends[:-1] - n
        keep[at[at < packed.size]] = False
    return packed[keep], sizes - ORDER + 1


def word_keys(words: list[str]) -> np.ndarray:
    """As Spark's xxhash64 has them."""
    return np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) & (WORD - 1) | WORD for w in words], np.int64)


def count_words(rows: DataFrame) -> DataFrame:
    """word, and toxic_ and ordinary_ for each of PARTS, over (text, label, for_curve) rows: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(4)]

        def table() -> pa.RecordBatch:
            words = list(set().union(*seen))
            parts = [pa.array([counter[w] for w in words], pa.int64()) for counter in seen]
            for counter in seen:
                counter.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *parts], ["word", "t", "o", "t_curve", "o_curve"])

        for batch in batches:
            for text, label, curve in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                seen[(0 if label else 1) + (2 if curve else 0)].update(text.lower().split())
            if sum(map(len, seen)) > CACHE_WORDS:
                yield table()
        yield table()

    each = rows.select("text", "label", "for_curve").mapInArrow(run, "word string, t long, o long, t_curve long, o_curve long")
    total = each.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t", "o", "t_curve", "o_curve")))
    return total.select("word", F.col("t").alias("toxic_own"), F.col("o").alias("ordinary_own"), (F.col("t") + F.col("t_curve")).alias("toxic_all"), (F.col("o") + F.col("o_curve")).alias("ordinary_all"))


COUNTS = [f"{c}_{part}" for part in PARTS for c in ("toxic", "ordinary")]


def count_grams(words: DataFrame) -> DataFrame:
    """gram and COUNTS, from those of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = grams(batch.column(0).to_pylist())
            keys, at = np.unique(own, return_inverse=True)
            sums = [np.bincount(at, weights=np.repeat(batch.column(k).to_numpy(), n), minlength=keys.size).astype(np.int64) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["gram", *COUNTS])

    each = words.select("word", *COUNTS).mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in COUNTS))
    return each.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def backed_off(counted: DataFrame) -> DataFrame:
    """``counted`` with below_ for each of PARTS: ``shared_backoff`` as joins. A context has 256 n-grams at most, so no key is large."""
    levels = [counted.select("gram", *((F.col(f"toxic_{p}") + F.col(f"ordinary_{p}") > 0).cast("long").alias(f"c_{p}") for p in PARTS))]
    for order in range(ORDER - 1, 0, -1):
        ending = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        levels.append(materialise(levels[-1].groupBy(ending).agg(*(F.count_if(F.col(f"c_{p}") > 0).alias(f"c_{p}") for p in PARTS)), "toxicity-endings"))
    below = None
    for n in range(len(levels) - 1, 0, -1):
        order = ORDER - n
        totals = levels[n].groupBy(F.shiftright("gram", 8).alias("context")).agg(*(x for p in PARTS for x in (F.sum(f"c_{p}").alias(f"total_{p}"), F.count_if(F.col(f"c_{p}") > 0).alias(f"kinds_{p}"))))
        own = levels[n].withColumn("context", F.shiftright("gram", 8)).join(totals, "context")
        if below is None:
            own = own.select("*", *(F.lit(1 / 256).alias(f"below_{p}") for p in PARTS))
        else:
            own = own.withColumn("ending", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(below, "ending")
        size = {p: F.greatest(F.col(f"total_{p}"), F.lit(1)) for p in PARTS}
        chance = [(F.greatest(F.col(f"c_{p}") - DISCOUNT, F.lit(0.0)) / size[p] + DISCOUNT * F.col(f"kinds_{p}") / size[p] * F.col(f"below_{p}")).alias(f"below_{p}") for p in PARTS]
        below = materialise(own.select(F.col("gram").alias("ending"), *chance), "toxicity-below")
    last = F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    return counted.withColumn("ending", last).join(below, "ending").drop("ending")


def gram_tables(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram and ratio_, context and fall_, for each of PARTS; null where these counts don't have it."""
    context = F.shiftright("gram", 8).alias("context")
    totals = counted.groupBy(context).agg(*(x for c in COUNTS for x in (F.sum(c).alias(f"total_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))))
    left = {c: F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in COUNTS}
    totals = materialise(totals.select("context", *(F.col(f"total_{c}") for c in COUNTS), *(left[c].alias(f"left_{c}") for c in COUNTS)), "toxicity-contexts")
    rows = backed_off(counted).withColumn("context", F.shiftright("gram", 8)).join(totals, "context")
    log = lambda c, p: F.log(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total_{c}"), F.lit(1)) + F.col(f"left_{c}") * F.col(f"below_{p}"))
    ratios = [F.when(F.col(f"toxic_{p}") + F.col(f"ordinary_{p}") > 0, log(f"toxic_{p}", p) - log(f"ordinary_{p}", p)).alias(f"ratio_{p}") for p in PARTS]
    falls = [F.when(F.col(f"total_toxic_{p}") + F.col(f"total_ordinary_{p}") > 0, F.log(f"left_toxic_{p}") - F.log(f"left_ordinary_{p}")).alias(f"fall_{p}") for p in PARTS]
    return materialise(rows.select("gram", *ratios), "toxicity-ratios"), materialise(totals.select("context", *falls), "toxicity-falls")


def word_table(words: DataFrame) -> DataFrame:
    """word and own_ for each of PARTS: ``_words`` over the table."""
    sums = words.agg(*(x for c in COUNTS for x in (F.coalesce(F.sum(c), F.lit(0)).alias(c), F.count_if(F.col(c) > 0).alias(f"kinds_{c}")))).first()
    ratios = []
    for p in PARTS:
        both = F.col(f"toxic_{p}") + F.col(f"ordinary_{p}")
        shared = both / max(1.0, float(sums[f"toxic_{p}"] + sums[f"ordinary_{p}"]))
        logs = []
        for c in (f"toxic_{p}", f"ordinary_{p}"):
            total = max(1.0, float(sums[c]))
            logs.append(F.log(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total + max(DISCOUNT * sums[f"kinds_{c}"] / total, 1e-9) * shared))
        ratios.append(F.when(both > 0, logs[0] - logs[1]).alias(f"own_{p}"))
    return materialise(words.select("word", *ratios), "toxicity-words")


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


def shared_backoff(keys: np.ndarray) -> np.ndarray:
    """The probability of each n-gram's last byte by its shorter endings, from continuation counts of both classes."""
    levels = [(keys, np.ones(keys.size))]
    for order in range(ORDER - 1, 0, -1):
        endings, count = np.unique(levels[-1][0] & ((1 << 8 * order) - 1), return_counts=True)
        levels.append((endings, count.astype(float)))
    below = np.full(levels[-1][0].size, 1 / 256)
    probability = below
    for n in range(len(levels) - 1, 0, -1):
        own, count = levels[n]
        _, at = np.unique(own >> 8, return_inverse=True)
        total = np.bincount(at, weights=count)[at]
        kinds = np.bincount(at)[at]
        probability = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * kinds / total * below
        upper = levels[n - 1][0]
        below = probability[find(own, upper & ((1 << 8 * (ORDER - n)) - 1))[0]]
    return below


def _words(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of words, and the log-likelihood ratio of each, interpolated with its share of both classes."""
    order = np.argsort(keys)
    toxic, ordinary = toxic[order], ordinary[order]
    shared = (toxic + ordinary) / max(1.0, (toxic + ordinary).sum())
    logs = []
    for count in (toxic, ordinary):
        total = max(1.0, count.sum())
        logs.append(np.log(np.maximum(count - DISCOUNT, 0) / total + max(DISCOUNT * (count > 0).sum() / total, 1e-9) * shared))
    return keys[order], logs[0] - logs[1]


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary) of n-grams, and of falling back from a context, of counts held in memory."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    fall: np.ndarray
    vocabulary: np.ndarray
    word_ratio: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
        whole = keys >= WORD
        vocabulary, word_ratio = _words(keys[whole], toxic[whole].astype(float), ordinary[whole].astype(float))
        keys, toxic, ordinary = keys[~whole], toxic[~whole], ordinary[~whole]
        order = np.argsort(keys)
        keys, below = keys[order], shared_backoff(keys[order])
        contexts, at = np.unique(keys >> 8, return_inverse=True)
        logs, falls = [], []
        for count in (toxic[order].astype(float), ordinary[order].astype(float)):
            total = np.bincount(at, weights=count, minlength=contexts.size)
            kinds = np.bincount(at, weights=count > 0, minlength=contexts.size)
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[at] + left[at] * below))
            falls.append(np.log(left))
        return cls(keys, logs[0] - logs[1], contexts, falls[0] - falls[1], vocabulary, word_ratio, np.zeros(FEATURES + 1))

    def words(self, words: list[str]) -> np.ndarray:
        """A row for each word: the summed ratio of its n-grams, their number, its own ratio."""
        own, n = grams(words)
        at, there = find(self.keys, own)
        up, known = find(self.contexts, own >> 8)
        each = np.where(there, self.ratio[at] if self.keys.size else 0.0, np.where(known, self.fall[up] if self.contexts.size else 0.0, 0.0))
        if not words:
            return np.zeros((0, 3))
        place, seen = find(self.vocabulary, word_keys(words))
        own_ratio = np.where(seen, self.word_ratio[place] if self.vocabulary.size else 0.0, 0.0)
        return np.stack([np.add.reduceat(each, np.concatenate(([0], np.cumsum(n)[:-1]))), n, own_ratio], axis=1)


@dataclass
class Held:
    """The model in memory, for counts of a bounded number: one ``Model`` for each of PARTS, and the curve."""

    models: dict[str, Model]
    weights: np.ndarray

    @classmethod
    def build(cls, words: DataFrame, counted: DataFrame) -> Held:
        """From distinct words and n-grams with COUNTS."""
        whole, models = counted.select("gram", *(F.col(c).cast("int") for c in COUNTS)).toArrow(), {}
        own = word_table(words).select(F.xxhash64("word").bitwiseAND(F.lit(WORD - 1)).bitwiseOR(F.lit(WORD)).alias("key"), *(F.col(f"own_{p}").cast("float") for p in PARTS)).toArrow()
        vocabulary = own.column("key").to_numpy()
        order = np.argsort(vocabulary)
        vocabulary = vocabulary[order]
        for p in PARTS:
            keys, toxic, ordinary = (whole.column(c).to_numpy() for c in ("gram", f"toxic_{p}", f"ordinary_{p}"))
            seen = toxic + ordinary > 0
            models[p] = Model.build(keys[seen], toxic[seen], ordinary[seen])
            models[p].vocabulary, models[p].word_ratio = vocabulary, own.column(f"own_{p}").to_numpy(zero_copy_only=False)[order]
            models[p].word_ratio = np.nan_to_num(models[p].word_ratio)
        return cls(models, np.zeros(FEATURES + 1))


@dataclass
class Tables:
    """The model as tables, the ratios of its most frequent words in memory, and the curve."""

    grams: DataFrame
    contexts: DataFrame
    words: DataFrame
    cached: tuple[np.ndarray, dict[str, np.ndarray]]
    weights: np.ndarray

    @classmethod
    def build(cls, words: DataFrame, counted: DataFrame, cached: int | None = None) -> Tables:
        """From distinct words and n-grams with COUNTS."""
        ratios, falls = gram_tables(counted)
        model = cls(ratios, falls, word_table(words), (np.zeros(0, np.int64), {}), np.zeros(FEATURES + 1))
        most = words.orderBy(F.desc(F.col("toxic_all") + F.col("ordinary_all")), "word").limit(CACHED_WORDS if cached is None else cached).select("word")
        table = model.ratios_of(materialise(most, "toxicity-frequent")).toArrow()
        keys = word_keys(table.column("word").to_pylist())
        order = np.argsort(keys)
        model.cached = keys[order], {p: np.stack([table.column(f"{c}_{p}").to_numpy()[order] for c in ("sum", "own")], axis=1) for p in PARTS}
        return model

    def ratios_of(self, words: DataFrame) -> DataFrame:
        """``words`` (distinct) with sum_, the summed ratio of a word's n-grams, and own_, its own ratio, for each of PARTS."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    own, n = grams(batch.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n.size), n))), pa.array(own)], ["word", "gram"])

        each = words.select("word").mapInArrow(run, "word string, gram long")
        short = F.col("gram") < SHORT
        each = each.withColumn("context", F.shiftright("gram", 8)).withColumn("salt", F.when(short, F.pmod(F.xxhash64("word"), F.lit(SALTS))).otherwise(0).cast("int"))
        dealt = lambda df, few: df.withColumn("salt", F.explode(F.when(few, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        # a short n-gram has a context below SHORT >> 8; a longer one's is above
        rows = each.join(dealt(self.grams, short), ["gram", "salt"], "left").join(dealt(self.contexts, F.col("context") < SHORT >> 8), ["context", "salt"], "left")
        sums = rows.groupBy("word").agg(*(F.sum(F.coalesce(f"ratio_{p}", f"fall_{p}", F.lit(0.0))).alias(f"sum_{p}") for p in PARTS))
        found = words.join(sums, "word").join(self.words, "word", "left")
        return found.select(*words.columns, *(F.col(f"sum_{p}") for p in PARTS), *(F.coalesce(f"own_{p}", F.lit(0.0)).alias(f"own_{p}") for p in PARTS))


class Scorer:
    """What a text's known words add to its features, and its other words; remembers words."""

    def __init__(self, ratios: Callable[[list[str]], list[tuple[float, float] | None]]):
        self.ratios, self.known = ratios, {}

    def parts(self, batch: list[str]) -> Iterator[tuple]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        docs = [text.lower().split() for text in batch]
        new = list(set().union(*docs).difference(self.known))
        self.known.update(zip(new, self.ratios(new) if new else [], strict=True))
        for words in docs:
            found = list(map(self.known.__getitem__, words))
            rest = Counter(w for w, x in zip(words, found, strict=True) if x is None) if None in found else {}
            ratios = np.array([x for x in found if x is not None] if rest else found).reshape(-1, 2)
            beyond = [np.maximum(ratios - level, 0).sum(axis=0) for level in LEVELS]
            each = np.stack([ratios.sum(axis=0), *beyond, ratios.max(axis=0, initial=0)])
            yield sum(len(w.encode()) + 1 for w in words), len(words), each[:, 0].tolist(), each[:, 1].tolist(), [{"word": w, "n": n} for w, n in rest.items()]


def cached_ratios(keys: np.ndarray, ratios: np.ndarray) -> Callable[[list[str]], list[tuple[float, float] | None]]:
    def of(words: list[str]) -> list[tuple[float, float] | None]:
        at, there = find(keys, word_keys(words))
        return [tuple(ratios[k].tolist()) if t else None for k, t in zip(at, there, strict=True)]

    return of


def parts_of(rows: DataFrame, held: Broadcast, ratios: Callable) -> DataFrame:
    """row, doc_id and what the known words of each (doc_id, text) row add to its features. ``ratios`` makes a Scorer's function of what is held."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))]
    names = ["n_grams", "n_words", "grams", "words", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, first = Scorer(ratios(held.value)), TaskContext.get().partitionId() << 36
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                parts = list(zip(*scorer.parts(batch.column("text").to_pylist()), strict=True))
                ids = np.arange(first, first + batch.num_rows)
                first += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), *map(pa.array, parts, kinds)], ["row", "doc_id", *names])

    of_doc = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {of_doc}, n_grams long, n_words long, grams array<double>, words array<double>, rest array<struct<word:string,n:int>>"
    return rows.select("doc_id", "text").mapInArrow(run, schema)


def added_by_rest(own: DataFrame, model: Tables, part: str) -> DataFrame:
    """row, more_grams, more_words: what the words that weren't held add."""
    each = own.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    known = materialise(model.ratios_of(each.groupBy("word").agg(F.count("*").alias("times"))), "toxicity-rest").select("word", "times", F.col(f"sum_{part}").alias("grams"), F.col(f"own_{part}").alias("words"))
    # a word of many documents meets its counts in HEAVY_PARTS parts, by document
    often = broadcast_if_small(known.where(F.col("times") >= HEAVY).select("word", F.lit(True).alias("often")), MOST_OFTEN)
    salted = each.join(often, "word", "left").withColumn("salt", F.when(F.col("often"), F.pmod("row", F.lit(HEAVY_PARTS))).otherwise(0)).drop("often")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("times") >= HEAVY, HEAVY_PARTS - 1).otherwise(0)))).drop("times")
    found = salted.join(spread.withColumn("salt", F.col("salt").cast("long")), ["word", "salt"])
    zero = F.lit(0.0)
    sums = lambda c: F.array(F.sum(F.col(c) * F.col("n")), *(F.sum(F.greatest(F.col(c) - level, zero) * F.col("n")) for level in LEVELS), F.max(F.greatest(F.col(c), zero)))
    return found.groupBy("row").agg(sums("grams").alias("more_grams"), sums("words").alias("more_words"))


def _features(rows: DataFrame, model: Held | Tables, part: str) -> DataFrame:
    """doc_id, x (the features) of each (doc_id, text) row."""
    context = rows.sparkSession.sparkContext
    if isinstance(model, Held):
        joined = parts_of(rows, context.broadcast(model.models[part]), lambda m: lambda words: list(map(tuple, m.words(words)[:, [0, 2]].tolist())))
        joined = joined.select("*", F.lit(None).cast("array<double>").alias("more_grams"), F.lit(None).cast("array<double>").alias("more_words"))
    else:
        own = materialise(parts_of(rows, context.broadcast((model.cached[0], model.cached[1][part])), lambda x: cached_ratios(*x)), "toxicity-parts")
        joined = own.drop("rest").join(added_by_rest(own, model, part), "row", "left")
    clip = lambda c: F.greatest(F.lit(-50.0), F.least(F.lit(50.0), c))
    x, last = [], len(LEVELS) + 1
    for column, parts in (("grams", "n_grams"), ("words", "n_words")):
        value = lambda k, c=column: F.get(c, F.lit(k))
        more = lambda k, c=column: F.coalesce(F.get(f"more_{c}", F.lit(k)), F.lit(0.0))
        per = lambda k, n: F.when(F.col(n) > 0, 100 * (value(k) + more(k)) / F.col(n)).otherwise(0.0)
        x += [per(0, parts), *(per(k, "n_words") for k in range(1, last)), F.greatest(value(last), more(last))]
    return joined.select("doc_id", F.array(*map(clip, x)).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Held | Tables:
    """A model from the labelled rows that ``training`` (over doc_id) admits."""
    own = labelled(labels, "toxic").where(training)
    known = texts(docs).join(broadcast_if_small(own, MOST_LABELS), "doc_id")
    for_curve = fold(F.reverse(F.col("doc_id").cast("string")), 4) == 0
    once = known.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "label", for_curve.alias("for_curve"))
    once = materialise(once, "toxicity-rows")
    rows = texts(docs).join(broadcast_if_small(once, MOST_LABELS), "doc_id")
    words = materialise(count_words(rows), "toxicity-seen")
    counted = materialise(count_grams(words), "toxicity-counts")
    held = words.count() + counted.count() <= MOST_HELD
    model = Held.build(words, counted) if held else Tables.build(words, counted)
    curve = once.where("for_curve").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS).select("doc_id", "label")
    sample = _features(texts(docs).join(F.broadcast(curve.select("doc_id")), "doc_id"), model, "own").join(F.broadcast(curve), "doc_id").toPandas()
    if sample["label"].nunique() == 2:
        model.weights = logistic(np.array(sample["x"].tolist()), sample["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Held | Tables) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of each row."""
    sums = sum((F.get("x", F.lit(k)) * float(w) for k, w in enumerate(model.weights[:-1])), F.lit(float(model.weights[-1])))
    return _features(texts(docs), model, "all").select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sums))))).alias("score"))

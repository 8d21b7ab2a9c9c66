"""Set-similarity self-join of documents by word n-grams, with set-relation skipping.

Each distinct set of n-grams is listed under its first n-grams in an order that puts frequent ones last; two sets
that are alike enough share a list. An entry of a list knows its set's size and the n-gram's position.

Skipping: pairs whose sizes or positions can't reach the overlap are dropped where lists are read. Long lists are cut in
blocks by size and position; two blocks are read together only if their bounds can reach it, the others are skipped
unread.

Leaders: in each list the sets are compared with the first and the last by id; then with neighbours by id that lie
in another component; then all pairs that are left between components of a list are. So no link between components is lost.

Derived answers: a link lies within a component. There, in blocks of sets dealt out by component, the answers of one set are
computed, and those of the others derived from them by the n-grams in which they differ from it: with d of its n
n-grams missing in one set and d' in another, both share n - d - d' of them, and what they lack together or have
in addition together. So links are counted (and listed, if asked for) without a row for each pair.

Parity bitmaps, whose differing bits can't outnumber the differing n-grams, drop most pairs before texts are read again; every
link is verified by whole sets. Sets are known by 63-bit hashes of their n-grams' 63-bit hashes, like the n-grams
themselves. Frequent n-grams only change the order, so the bound on their number (HOT) costs time, never a link.

Defined cases: null and empty texts, and those without words, have empty sets, linked with nothing; with fewer
words than an n-gram the whole sequence is one. Repeated rows share a set. A null id is no candidate for a
component's smallest id, but its row links as any other. An empty table gives an empty result. A text of any length is
read whole. Columns besides doc_id and text are ignored; ``keep_one`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.common import broadcast_if_small, discard, materialise, texts

WORDS, NUMERATOR, DENOMINATOR = 5, 8, 10
#: n-grams that are put last, at most; each stands in HOT_SETS documents or more.
HOT, HOT_SETS = 200_000, 32
#: Share of the hash range whose n-grams are counted over all documents, and the set size up to which all are.
COUNTED_SHARE, SMALL = 0.25, 32
COUNTED = int(COUNTED_SHARE * (1 << 63))
#: 64-bit words of the smallest and the largest bitmap, and n-grams for each.
LEAST_BITS, MOST_BITS, GRAMS_A_WORD = 8, 512, 32
MOST_WANTED = 500_000
#: Entries of a block of a long list, about, and parts of a prefix that its positions are told apart by; sets that are compared with one at once;
#: sets of a block of a component.
BLOCK, PLACES, FAN, GROUP = 500, 4, 200, 128
#: Which neighbours by id a set of a long list is compared with, and n-grams, in the order of prefixes, by which a pair of such sets knows its first list.
NEIGHBOURS, FIRSTS = (1, 3, 9, 27), 16
#: Columns of the matrix of differences at once.
WIDTH = 8_192
CACHE_WORDS = 200_000
POSITIVE = (1 << 63) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Shingles:
    """Sorted distinct n-gram hashes of a text."""

    def __init__(self, words: int):
        self.words, self.known = words, WordHashes()

    def of(self, text: str) -> np.ndarray:
        parts = text.encode().lower().split()  # for bytes: A-Z, and white space of ASCII
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        own = np.fromiter(map(self.known.__getitem__, parts), np.uint64, len(parts))
        if not own.size:
            return np.zeros(0, np.int64)
        width = min(self.words, own.size)
        value = np.full(own.size - width + 1, width, np.uint64)
        for n in range(width):
            value = (value ^ own[n : n + value.size]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return np.unique((value & np.uint64(POSITIVE)).astype(np.int64))


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=1) & POSITIVE


def parity(tokens: np.ndarray) -> np.ndarray:
    """Each n-gram flips one bit; the larger the set, the more bits: a power of two of 64-bit words."""
    words = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, tokens.size // GRAMS_A_WORD) - 1).bit_length()))
    flips = np.bincount(tokens & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def table(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def short(tokens: np.ndarray) -> np.ndarray:
    """31 bits of a hash: enough to tell frequent n-grams, and half the shuffle."""
    return (tokens & 0x7FFFFFFF).astype(np.int32)


def among(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which n-grams have one of the sorted short keys."""
    tokens = short(tokens)
    if not hot.size:
        return np.zeros(tokens.size, bool)
    return hot[np.minimum(np.searchsorted(hot, tokens), hot.size - 1)] == tokens


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, bool]:
    """Sorted short keys of n-grams that many documents hold, of those in the counted part of the hash range (of small sets, of all);
    and whether these are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in sliced(batches):
            own = [short(s if s.size <= SMALL else s[: np.searchsorted(s, COUNTED)]) for s in map(shingles.of, batch.column(0).to_pylist())]
            keys, n = np.unique(np.concatenate(own), return_counts=True)
            yield table({"token": (keys, pa.int32()), "n": (n.astype(np.int32), pa.int32())})

    counted = texts(docs).select("text").mapInArrow(run, "token int, n int").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= HOT_SETS).orderBy(F.desc("n"), "token").limit(HOT).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int32)), len(rows) < HOT


def index(docs: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, h, sid, n, bits, prefix, narrow of each document: its set, its first n-grams in the order, and how many of
    these are known to be in fewer than HOT_SETS documents."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in sliced(batches):
            sets = [shingles.of(t) for t in batch.column(2).to_pylist()]
            (often, whole), prefixes, narrow = hot.value, [], []
            for s in sets:
                late = among(s, often)
                size = s.size - -(-numerator * s.size // denominator) + 1 if s.size else 0
                early = s[~late]
                prefixes.append(np.concatenate([early, s[late]])[:size])
                narrow.append(min(size, int(np.searchsorted(early, COUNTED))) if whole else 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([set_id(s) if s.size else None for s in sets], pa.int64()), pa.array([s.size for s in sets], pa.int32()),
                pa.array([parity(s) for s in sets], pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(narrow, pa.int32()),
            ], ["doc_id", "h", "sid", "n", "bits", "prefix", "narrow"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, sid long, n int, bits array<long>, prefix array<long>, narrow int")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "set-index")


class Join:
    """One self-join: components of linked sets first, then, where asked for, the links within them."""

    def __init__(self, docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.docs, self.words, self.up, self.down = docs, words, numerator, denominator
        rows = index(docs, words, numerator, denominator)
        first = broadcast_if_small(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("row").alias("row")).select("row"), 2 * MOST_WANTED)
        sets = rows.join(first, "row", "left_semi")
        self.lists = materialise(self.narrow_lists(sets).unionByName(self.wide_lists(sets)), "set-lists")
        listed = self.lists.select("sid").distinct()
        self.sets = materialise(sets.select("sid", "doc_id", "h", "n", "bits").join(listed, "sid", "left_semi"), "set-heads")
        self.members = materialise(rows.select("doc_id", "sid", "n"), "set-members")
        discard(rows)

    def may_link(self, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
        """By sizes and positions of one common n-gram."""
        sizes = (F.least(na, nb) * self.down >= F.greatest(na, nb) * self.up) & (na > 0)
        return sizes & (F.least(na - pa_, nb - pb) * (self.up + self.down) >= (na + nb) * self.up)

    def with_leaders(self, entries: DataFrame, *by: str) -> DataFrame:
        """Entries of lists (or blocks) of several sets, with partners: the first and the last by id, where they may link."""
        own = Window.partitionBy(*by).orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        entry = F.struct("sid", "n", "place")
        rows = entries.withColumn("first", F.first(entry).over(own)).withColumn("last", F.last(entry).over(own)).withColumn("size", F.count("*").over(own))
        ends = F.filter(F.array("first", "last"), lambda e: (e["sid"] != F.col("sid")) & self.may_link(F.col("n"), F.col("place"), e["n"], e["place"]))
        return rows.withColumn("partners", F.transform(ends, lambda e: e["sid"])).drop("first", "last")

    def narrow_lists(self, sets: DataFrame) -> DataFrame:
        """Lists of n-grams in fewer than HOT_SETS documents, so a list is small."""
        entries = sets.select("sid", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("narrow"))).alias("place", "token"))
        return self.with_leaders(entries, "token").where("size > 1").select("token", "sid", "n", "place", F.lit(None).cast("long").alias("block"), "partners")

    def wide_lists(self, sets: DataFrame) -> DataFrame:
        """All other lists, in blocks of like sizes and positions: BLOCK sets of one size and position stay together by a hash."""
        rest = F.transform(F.slice("prefix", F.col("narrow") + 1, F.size("prefix")), lambda t, i: F.struct((F.col("narrow") + i).alias("place"), t.alias("token")))
        entries = sets.where(F.size("prefix") > F.col("narrow")).select("sid", "n", F.explode(rest).alias("e")).select("e.token", "sid", "n", "e.place")
        often = entries.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
        size = F.floor(F.log("n") / np.log(self.down / self.up))
        place = F.floor(PLACES * F.col("place") * self.down / (F.col("n") * (self.down - self.up) + self.down))
        dealt = F.pmod(F.xxhash64("sid"), F.ceil(F.col("times") / (PLACES * BLOCK)))
        block = F.when(F.col("times") > BLOCK, F.xxhash64(size, place, dealt)).otherwise(F.lit(0))
        blocks = entries.join(often, "token").withColumn("block", block).repartition("token", "block")
        return self.with_leaders(blocks, "token", "block").select("token", "sid", "n", "place", "block", "partners")

    def labelled_lists(self, labels: DataFrame) -> DataFrame:
        """Lists with sets of several components (and all blocks of long ones): label, and as partner the neighbour by id in another one."""
        own = self.lists.drop("partners").join(broadcast_if_small(labels, MOST_WANTED), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        block = Window.partitionBy("token", "block").orderBy("sid")
        whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        entry = F.struct("sid", "n", "place", "label")
        rows = own.withColumn("mixed", F.min("label").over(whole) != F.max("label").over(whole)).withColumns({f"before{k}": F.lag(entry, k).over(block) for k in NEIGHBOURS}).where("mixed OR block IS NOT NULL")
        near = F.filter(
            F.array(F.col("before1"), *(F.when(F.col("block").isNotNull(), F.col(f"before{k}")) for k in NEIGHBOURS[1:])),
            lambda e: e.isNotNull() & (e["label"] != F.col("label")) & self.may_link(F.col("n"), F.col("place"), e["n"], e["place"]),
        )
        return materialise(rows.select("token", "block", "sid", "n", "place", "label", F.transform(near, lambda e: e["sid"]).alias("partners")), "set-mixed")

    def across(self, mixed: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of a common list in different components that sizes and positions allow."""
        own = mixed.drop("label", "partners").join(broadcast_if_small(labels, MOST_WANTED), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        may = self.may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")) & (F.col("x.label") != F.col("y.label"))
        pair = (F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
        short_lists = own.where("block IS NULL")
        close = short_lists.alias("x").join(short_lists.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.sid") < F.col("y.sid")) & may).select(*pair)
        wide = own.where("block IS NOT NULL")
        in_order = F.array_sort(F.collect_set(F.struct("place", "token")))
        firsts = wide.groupBy("sid").agg(F.slice(F.transform(in_order, lambda e: e["token"]), 1, FIRSTS).alias("firsts"))
        fold = F.transform(F.sequence(F.lit(0), F.lit(LEAST_BITS - 1)), lambda i: F.aggregate(F.filter("bits", lambda x, k: k % LEAST_BITS == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
        many = materialise(wide.join(firsts, "sid").join(self.sets.select("sid", fold.alias("fold")), "sid"), "set-wide")
        left = F.col("n") - F.col("place")
        blocks = many.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(left).alias("left"), F.min("label").alias("least"), F.max("label").alias("most"))
        reach = (F.col("x.low") * self.up <= F.col("y.high") * self.down) & (F.col("y.low") * self.up <= F.col("x.high") * self.down)
        reach &= F.least("x.left", "y.left") * (self.up + self.down) >= (F.col("x.low") + F.col("y.low")) * self.up
        reach &= (F.col("x.least") != F.col("y.most")) | (F.col("x.most") != F.col("y.least"))
        read = blocks.alias("x").join(blocks.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) & reach)
        read = read.select(F.col("x.token").alias("token"), F.col("x.block").alias("block"), F.col("y.block").alias("other"))
        x = many.join(broadcast_if_small(read, MOST_WANTED), ["token", "block"]).alias("x")
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.other") == F.col("y.block")) & ((F.col("x.block") < F.col("y.block")) | (F.col("x.sid") < F.col("y.sid")))
        differ = reduce(Column.__add__, (F.bit_count(F.col("x.fold")[n].bitwiseXOR(F.col("y.fold")[n])) for n in range(LEAST_BITS)))
        few = differ * (self.up + self.down) <= (F.col("x.n") + F.col("y.n")) * (self.down - self.up)
        # Prefixes have one order, so both sets agree on the first n-gram that they share; the bound by positions holds there.
        shared = F.array_intersect("x.firsts", "y.firsts")
        once = (F.size(shared) == 0) | (F.element_at(shared, 1) == F.col("x.token"))
        return close.unionAll(x.join(many.alias("y"), same & may & few & once).select(*pair)).distinct()

    def few_differ(self, size: Column) -> Column:
        """Whether bits_a and bits_b leave enough common n-grams possible. The longer one is folded to the length of the other."""

        def fold(bits: Column, other: Column) -> Column:
            half = F.floor(F.size(bits) / 2).cast("int")
            return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)

        a, b = F.col("bits_a"), F.col("bits_b")
        differ = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return differ * (self.up + self.down) <= size * (self.down - self.up)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are as alike as asked. All b of an a meet its n-grams, FAN in a group."""
        heads = self.sets.select("sid", "n", "bits")
        x, y = (heads.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b")
        na, nb = F.col("n_a"), F.col("n_b")
        # bitmaps of sets that may link differ by a factor of two in length, at most, if the asked likeness is over 1/2
        foldable = (F.size("bits_a") <= 2 * F.size("bits_b")) & (F.size("bits_b") <= 2 * F.size("bits_a"))
        close = both.where((F.least(na, nb) * self.down >= F.greatest(na, nb) * self.up) & (~foldable | self.few_differ(na + nb)))
        close = materialise(close.select("a", "b"), "set-pairs")
        parts = close.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
        asks = close.join(parts, "a").select(F.col("b").alias("sid"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")).alias("ask"))
        asks = asks.unionByName(parts.select(F.col("a").alias("sid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("a"), p.alias("part")))).alias("ask")))
        found = self.tokens_of(asks.groupBy("sid").agg(F.collect_list("ask").alias("asks"))).select("sid", "tokens", F.explode("asks").alias("ask")).select("ask.a", "ask.part", "sid", "tokens")
        up, down = self.up, self.down

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """In order of a, its own row first."""
            one = None
            for batch in sliced(batches):
                keep = []
                for a, sid, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    two = np.frombuffer(tokens.as_buffer(), np.int64)
                    if sid == a:
                        one = two.copy()
                        continue
                    common = np.intersect1d(one, two, assume_unique=True).size
                    if down * common >= up * (one.size + two.size - common):
                        keep.append((a, sid))
                yield table({"a": ([k[0] for k in keep], pa.int64()), "b": ([k[1] for k in keep], pa.int64())})

        groups = found.repartition("a", "part").sortWithinPartitions("a", "part", F.col("sid") != F.col("a"))
        return materialise(groups.mapInArrow(compare, "a long, b long").distinct(), "set-links")

    def tokens_of(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (sid and more) with tokens, the n-grams of each set, from one of its texts."""
        more = [c for c in wanted.columns if c != "sid"]
        asked = self.sets.select("sid", F.struct("doc_id", "h").alias("key")).join(wanted, "sid")
        rows = texts(self.docs).withColumn("own", F.struct("doc_id", F.xxhash64("text").alias("h"))).join(broadcast_if_small(materialise(asked, "set-asked"), MOST_WANTED), F.col("own").eqNullSafe(F.col("key")))
        words = self.words

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(words)
            for batch in sliced(batches):
                own = [shingles.of(t).tobytes() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.binary())], [*batch.schema.names[1:], "tokens"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.select("sid", *more).schema.fields)
        return rows.select("text", "sid", *more).mapInArrow(tokens, f"{kinds}, tokens binary")

    def labels(self) -> DataFrame:
        """sid, label of all sets that link with another one."""
        spread = lambda lists: lists.where(F.size("partners") > 0).select("sid", F.explode("partners").alias("other")).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
        links = self.linked(spread(self.lists))
        labels = connected(links)
        mixed = self.labelled_lists(labels)
        links = links.unionAll(self.linked(spread(mixed)))
        labels = connected(links)
        links = links.unionAll(self.linked(self.across(mixed, labels)))
        return connected(links)

    def components(self, labels: DataFrame | None = None) -> DataFrame:
        """sid, doc_id, n_shingles, component_id (the smallest id that links reach) of each row."""
        own = self.members.join(self.labels() if labels is None else labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
        joined = own.join(least, "label", "left")
        return joined.select("sid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))

    def grouped(self, labels: DataFrame) -> DataFrame:
        """label, low, high, block, sid, copies, tokens: the sets of each component, in all pairs of its blocks."""
        copies = self.members.where("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies"))
        sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
        dealt = labels.join(sizes, "label").join(copies, "sid").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        held = self.tokens_of(dealt)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        return held.select("label", "block", "sid", "copies", "tokens", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")

    def count_links(self, labels: DataFrame) -> DataFrame:
        """sid, others: the number of documents whose sets differ and are as alike as asked."""
        up, down = self.up, self.down

        def count(group: pa.Table) -> pa.Table:
            sids, copies, linked = derived(group, up, down)
            others = linked @ copies
            return pa.table({"sid": pa.array(sids, pa.int64()), "others": pa.array(others.astype(np.int64))})

        each = self.grouped(labels).groupBy("label", "low", "high").applyInArrow(count, "sid long, others long")
        return each.groupBy("sid").agg(F.sum("others").alias("others"))

    def pairs(self) -> DataFrame:
        """a, b (a < b): all different sets as alike as asked."""
        up, down = self.up, self.down

        def listed(group: pa.Table) -> pa.Table:
            sids, _, linked = derived(group, up, down)
            a, b = np.nonzero(np.triu(linked | linked.T))
            own = np.stack([sids[a], sids[b]])
            return pa.table({"a": pa.array(own.min(axis=0)), "b": pa.array(own.max(axis=0))})

        return self.grouped(self.labels()).groupBy("label", "low", "high").applyInArrow(listed, "a long, b long")

    def links(self) -> DataFrame:
        """doc_id, n_shingles, component_id, n_links (other rows as alike as asked, those of an equal set among them) of each row."""
        labels = self.labels()
        copies = self.members.where("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies"))
        counted = copies.join(materialise(self.count_links(labels), "set-counts"), "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        rows = self.components(labels).join(counted, "sid", "left")
        return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def derived(group: pa.Table, up: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sids, copies, and which sets of a group's lower block link with which of its higher one (of one block: all with all).

    The first set's answers come from its n-grams; those of all others from the n-grams in which they differ from it.
    """
    group = group.take(pa.array(np.unique(group.column("sid").to_numpy(), return_index=True)[1]))  # repeated rows
    sids, copies = group.column("sid").to_numpy(), group.column("copies").to_numpy()
    sets = [np.frombuffer(t.as_buffer(), np.int64) for t in group.column("tokens").combine_chunks()]
    size = np.array([s.size for s in sets])
    pivot = sets[0]
    lacks = [np.setdiff1d(pivot, s, assume_unique=True) for s in sets]
    adds = [np.setdiff1d(s, pivot, assume_unique=True) for s in sets]
    missing = np.array([x.size for x in lacks])
    where = np.repeat(np.arange(len(sets)), missing + [x.size for x in adds])
    _, what = np.unique(np.concatenate([y for x in zip(lacks, adds, strict=True) for y in x]), return_inverse=True)
    together = np.zeros((len(sets), len(sets)))
    order = np.argsort(what, kind="stable")
    where, what = where[order], what[order]
    for at in range(0, int(what[-1]) + 1 if what.size else 0, WIDTH):
        own = slice(*np.searchsorted(what, [at, at + WIDTH]))
        differs = np.zeros((len(sets), WIDTH), np.float32)
        differs[where[own], what[own] - at] = 1
        together += differs @ differs.T
    common = pivot.size - missing[:, None] - missing + together
    linked = down * common >= up * (size[:, None] + size - common)
    np.fill_diagonal(linked, False)
    low, high, block = (group.column(c).to_numpy() for c in ("low", "high", "block"))
    if low[0] != high[0]:
        linked &= block[:, None] != block
    return sids, copies, linked


def connected(links: DataFrame) -> DataFrame:
    """sid, label: the smallest id of each linked set's component, by passing on minima and jumping along them."""
    edges = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "set-edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("sid"), F.least("a", "b").alias("label")), "set-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["sid"] == near["a"]).select("sid", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("sid").alias("label"), F.col("label").alias("root"))
        new = materialise(lower.join(jump, "label", "left").select("sid", "was", F.least("label", "root").alias("label")), "set-labels")
        labels = new.select("sid", "label")
        if new.where("was != label").isEmpty():
            return labels


def pairs(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) of different sets, and the set of each row (doc_id, sid, n)."""
    join = Join(docs, words, numerator, denominator)
    return join.pairs(), join.members


def links(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    return Join(docs, words, numerator, denominator).links()


def components(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    return Join(docs, words, numerator, denominator).components().drop("sid")


def keep_one(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; rows of an id stay together."""
    kept = components(docs, words, numerator, denominator).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id IS NULL").unionAll(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))

"""Token ids as binary shards with a minimal perfect hash index.

A shard is one row of a Parquet table: ``part``, ``seq`` (its place in the order), ``n_ids``, ``payload``
(raw little-endian unsigned 32-bit ids of consecutive documents) and ``index``. The index maps a document's
key to its entry in constant time: hash levels place every key in a slot of its own (a key that meets
another one goes to the next level), the slot's rank among all set bits is the key's number, and a stored
fingerprint rejects keys that aren't there. Spark's writer commits whole files, so a lost executor leaves
no half-written shard.

Defined cases: a null text is empty and has only the end id. Rows come in ascending doc_id, equal ids by
text, null ids first; equal ids stand side by side under one key of several entries. A null id can't be
looked up but is stored and read back. An empty table makes no shards. A document longer than a shard gets
one of its own. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cratewise.llm.common import materialise, shared_folder, texts

#: Ids of a shard, but for a longer document.
SHARD_IDS = 250_000
#: Slots for each key of a level: more make the index larger and the levels fewer.
SLOTS_PER_KEY = 2.0
#: Bytes that a worker's encoded words may take, and about what one takes.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 200
#: Texts that are encoded together: so many, and of so many bytes but for a longer one.
SLICE_DOCS, SLICE_BYTES = 2_000, 4 << 20
#: Words that the library gets as one piece.
TOGETHER = 100
#: Keys of a directory's bucket, about, and the bytes of a shard's index for a key at least.
BUCKET_KEYS, KEY_BYTES = 50_000, 28
#: Buckets or parts that a fetch names in its filter, so that files without them aren't read; more are found by the join alone.
MOST_NAMED = 1_000
#: Where a single space parts two words, the vocabulary's splitting pattern never looks across it.
SPACES = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNEVEN_SPACE = f" {SPACES}|{SPACES} "


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys, 1_000_003).astype(np.uint32)


class KeyIndex:
    """Minimal perfect hash of distinct keys, with the first entry and the number of entries of each."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.levels, self.prints, self.first, self.count = levels, prints, first, count
        self.before = [np.concatenate(([0], np.cumsum(bits))) for bits in levels]
        self.offset = np.concatenate(([0], np.cumsum([bits.sum() for bits in levels]))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, first: np.ndarray, count: np.ndarray) -> KeyIndex:
        levels, left = [], keys
        while left.size:
            slot = (mix(left, len(levels)) % np.uint64(max(8, int(SLOTS_PER_KEY * left.size)))).astype(np.int64)
            alone = np.bincount(slot, minlength=max(8, int(SLOTS_PER_KEY * left.size))) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        made = cls(levels, np.zeros(0, np.uint32), first, count)
        at = made.number(keys)
        made.prints, made.first, made.count = (np.empty(keys.size, np.uint32) for _ in range(3))
        made.prints[at], made.first[at], made.count[at] = fingerprint(keys), first, count
        return made

    def number(self, keys: np.ndarray) -> np.ndarray:
        """A key's number, or -1."""
        out = np.full(keys.size, -1, np.int64)
        rest = np.arange(keys.size)
        for level, bits in enumerate(self.levels):
            slot = (mix(keys[rest], level) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[slot]
            out[rest[hit]] = self.offset[level] + self.before[level][slot[hit]]
            rest = rest[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry and number of entries of each key; 0 entries where the fingerprint differs."""
        if not self.prints.size:
            return np.zeros(keys.size, np.int64), np.zeros(keys.size, np.int64)
        at = self.number(keys)
        there = (at >= 0) & (self.prints[at] == fingerprint(keys))
        return np.where(there, self.first[at], 0).astype(np.int64), np.where(there, self.count[at], 0).astype(np.int64)


def pack_index(keys: list[int | None], sizes: list[int]) -> bytes:
    """Keys of a shard's entries in order (nulls first, equal ones together), and the ids of each."""
    nulls = sum(k is None for k in keys)
    own = np.array(keys[nulls:], np.int64)
    unique, first, count = np.unique(own, return_index=True, return_counts=True)
    index = KeyIndex.build(unique.view(np.uint64), first + nulls, count)
    head = np.array([len(keys), nulls, unique.size, len(index.levels), *(b.size for b in index.levels)], np.int64)
    parts = [head, *(np.packbits(b) for b in index.levels), index.prints, index.first, index.count]
    return b"".join(x.tobytes() for x in [*parts, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), own])


class Shard:
    """Reads one shard."""

    def __init__(self, payload: bytes, index: bytes):
        self.payload, at = payload, 32
        entries, self.nulls, keys, n = np.frombuffer(index, np.int64, 4)
        sizes = np.frombuffer(index, np.int64, n, at)
        at += 8 * int(n)
        levels = []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(index, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        columns = []
        for _ in range(3):
            columns.append(np.frombuffer(index, np.uint32, keys, at))
            at += 4 * int(keys)
        self.index = KeyIndex(levels, *columns)
        self.offsets = np.frombuffer(index, np.int64, entries + 1, at)
        self.keys = np.frombuffer(index, np.int64, entries - self.nulls, at + 8 * (int(entries) + 1))

    def entry(self, n: int) -> bytes:
        return self.payload[4 * self.offsets[n] : 4 * self.offsets[n + 1]]

    def find(self, keys: np.ndarray) -> list[list[int]]:
        """The entries of each key."""
        first, count = self.index.lookup(keys.astype(np.int64).view(np.uint64))
        return [list(range(a, a + n)) for a, n in zip(first.tolist(), count.tolist(), strict=True)]


class Encoder:
    """Encodes texts with the tokenizers library; each distinct word once while it is kept.

    A word's ids are a run of ``ids``, named by its slot. Texts are split, and their words told apart, in Arrow;
    a text's ids are then gathered from the runs of all its words at once. ``text_only`` takes the strings of
    special tokens as ordinary text.
    """

    def __init__(self, path: str, text_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would spin on others'
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = text_only
        self.special = [] if text_only else [token.content for token in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1 + len(self.special), np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))  # a character of such a token is a byte
        self.forget()

    def forget(self) -> None:
        self.slots: tuple[dict[str, int], dict[str, int]] = {}, {}  # of words that follow a space, and of those that lead a text
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their number in each."""
        found = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(pieces))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, each with a space before it; many are encoded as one piece, and told apart by their bytes."""
        ids, _ = self._encode(["".join(f" {w}" for w in words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)])
        ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64) + 1)
        reached = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(reached, ends)
        if last.size and (last[-1] >= reached.size or (reached[last] != ends).any()):
            return self._encode([" " + w for w in words])
        return ids, np.diff(last + 1, prepend=0)

    def _slots(self, words: list[str], leads: bool) -> np.ndarray:
        """Slots of words, which differ unless they lead texts; new ones are encoded together."""
        known = self.slots[leads]
        new = [w for w in (dict.fromkeys(words) if leads else words) if w not in known]
        plain = [] if leads else [w for w in new if w and not w[-1].isspace()]
        others = new if leads else [" " + w for w in new if not w or w[-1].isspace()] if len(plain) < len(new) else []
        for group, asked, encode in ((plain, plain, self._encode_words), ([w if leads else w[1:] for w in others], others, self._encode)):
            if group:
                ids, size = encode(asked)
                known.update(zip(group, range(self.size.size, self.size.size + len(group)), strict=True))
                self.start = np.concatenate([self.start, self.ids.size + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _even(self, docs: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose words are parted by single spaces."""
        split = pc.split_pattern(docs, " ")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        lead = pc.take(split.flatten(), pa.array(first)).to_pylist()
        held, at = self._slots(words.dictionary.to_numpy(zero_copy_only=False).tolist(), False), words.indices.to_numpy()
        head = self._slots(lead, True)
        # strings come as a NumPy column, as a list of Arrow's is ten times slower; distinct words are looked up first, then all words
        start, size = self.start[held].astype(np.int32)[at], self.size[held].astype(np.int32)[at]
        start[first], size[first] = self.start[head], self.size[head]
        ends = np.cumsum(size, dtype=np.int32)
        start -= ends - size
        place = np.repeat(start, size)
        place += np.arange(place.size, dtype=np.int32)
        return np.split(self.ids[place], (ends - size)[first[1:]])

    def _whole(self, docs: pa.Array) -> list[np.ndarray]:
        ids, size = self._encode(docs.to_pylist())
        return np.split(ids, np.cumsum(size)[:-1])

    def batch(self, docs: pa.Array) -> list[np.ndarray]:
        """Ids of each text. A text with odd white space, or with a special token's string, is encoded as one piece."""
        if sum(map(len, self.slots)) * ENTRY_BYTES > CACHE_BYTES:
            self.forget()
        odd = pc.match_substring_regex(docs, UNEVEN_SPACE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(docs, token))
        out: list[np.ndarray | None] = [None] * len(docs)
        for some, encode in ((odd, self._whole), (pc.invert(odd), self._even)):
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if at.size:
                for k, ids in zip(at.tolist(), encode(docs.take(pa.array(at))), strict=True):
                    out[k] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, text_only: bool = False) -> Encoder:
    return Encoder(path, text_only)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a (doc_id, text) batch, cut by number and by bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        n = min(max(most - at, 1), SLICE_DOCS)
        yield batch.slice(at, n)
        at += n


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS, text_only: bool = False) -> None:
    """Encode ``docs``, in ascending doc_id, to shards at ``path``. One shuffle deals the rows out by id ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, tail = TaskContext.get().partitionId(), 0, np.uint32(end_id).tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            index = pack_index(keys, [len(x) // 4 for x in ids])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": [seq], "n_ids": [held], "payload": [b"".join(ids)], "index": [index]})

        for batch in batches:
            for some in slices(batch):
                for key, own in zip(some.column(0).to_pylist(), encoder(tokenizer_path, text_only).batch(some.column(1)), strict=True):
                    if held and held + own.size + 1 > shard_ids:
                        yield shard()
                        keys, ids, held, seq = [], [], 0, seq + 1
                    keys.append(key)
                    ids.append(own.tobytes() + tail)
                    held += own.size + 1
        if keys:
            yield shard()

    (
        texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(run, "part int, seq long, n_ids long, payload binary, index binary")
        .write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    )


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq long, n_ids long, payload binary, index binary").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, shard_start: the ids before each shard. One row a shard; sums of parts first, then within a part."""
    sizes = shards(spark, path).select("part", "seq", "n_ids")
    whole = sizes.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return inner.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("shard_start"))


def each_entry(digest: Callable[[bytes], int], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over shards: each entry, found through its key, with ``digest`` of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload, index in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload", "index")), strict=True):
                shard = Shard(payload, index)
                unique = np.unique(shard.keys)
                found = [(None, n) for n in range(shard.nulls)] + [(k, n) for k, own in zip(unique.tolist(), shard.find(unique), strict=True) for n in own]
                n = [x[1] for x in found]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(n), pa.int32()), "seq": pa.array([seq] * len(n), pa.int64()), "doc_id": pa.array([x[0] for x in found], pa.int64()),
                    "inner": pa.array(shard.offsets[n] if n else [], pa.int64()), "n_tokens": pa.array((shard.offsets[1:] - shard.offsets[:-1])[n] if n else [], pa.int64()),
                    name: pa.array([digest(shard.entry(i)) for i in n], pa.int64()),
                })

    return run


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, read through the index."""
    rows = shards(spark, path).select("part", "seq", "payload", "index").mapInArrow(each_entry(zlib.crc32, "ids_crc32"), "part int, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


DIRECTORY = "bucket long, buckets long, sizes array<long>, levels array<binary>, prints binary, places binary"
PLACE = "doc_id long, part int, seq long, entry long, last_seq long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each key's entries start in each shard."""
    for batch in batches:
        for part, seq, index in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "index")), strict=True):
            shard = Shard(b"", index)
            keys, first = np.unique(shard.keys, return_index=True)
            same = np.ones(keys.size, np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "part": pa.array(part * same, pa.int32()), "seq": pa.array(seq * same, pa.int64()), "entry": pa.array(first + int(shard.nulls), pa.int64())})


def _pack_bucket(group: pa.Table) -> pa.Table:
    """A bucket's keys as a minimal perfect hash, with a fingerprint and a place (part, seq, entry, last_seq) in the slot of each."""
    keys = group.column("doc_id").to_numpy().view(np.uint64)
    index = KeyIndex.build(keys, np.zeros(keys.size), np.zeros(keys.size))
    places = np.empty((keys.size, 4), np.int64)
    places[index.number(keys)] = np.column_stack([group.column(c).to_numpy() for c in ("part", "seq", "entry", "last_seq")])
    return pa.table({
        "bucket": group.column("bucket").slice(0, 1), "buckets": group.column("buckets").slice(0, 1), "sizes": pa.array([[b.size for b in index.levels]], pa.list_(pa.int64())),
        "levels": pa.array([[np.packbits(b).tobytes() for b in index.levels]], pa.list_(pa.binary())), "prints": [index.prints.tobytes()], "places": [places.tobytes()],
    })


def write_directory(spark: SparkSession, path: str, directory: str) -> None:
    """A table over all shards of ``path``: keys in buckets by their hash, each bucket a minimal perfect hash to shard and entry.

    Equal ids stand side by side in shards of one part, so a key is one row (where it starts, and its last shard) before it
    is dealt to its bucket, however often it is repeated. Without keys there are no buckets.
    """
    held = shards(spark, path).agg(F.sum(F.length("index"))).first()[0] or 0
    buckets = max(1, held // (BUCKET_KEYS * KEY_BYTES))
    runs = shards(spark, path).select("part", "seq", "index").mapInArrow(_runs, "doc_id long, part int, seq long, entry long")
    keys = runs.groupBy("doc_id").agg(F.min(F.struct("part", "seq", "entry")).alias("first"), F.max("seq").alias("last_seq"))
    keys = keys.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.lit(buckets).cast("long").alias("buckets"), "doc_id", "first.*", "last_seq")
    packed = keys.groupBy("bucket").applyInArrow(_pack_bucket, DIRECTORY)
    packed.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(directory)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that their bucket holds, with their places; a fingerprint rejects others but for one in four thousand million."""
    for batch in batches:
        for row in batch.to_pylist():
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["levels"], row["sizes"], strict=True)]
            own, prints = np.array(row["keys"], np.int64), np.frombuffer(row["prints"], np.uint32)
            at = KeyIndex(levels, prints, prints, prints).number(own.view(np.uint64))
            there = (at >= 0) & (prints[at] == fingerprint(own.view(np.uint64)))
            place = np.frombuffer(row["places"], np.int64).reshape(-1, 4)[at[there]].T
            yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int32() if n == "part" else pa.int64()) for n, x in zip(("doc_id", "part", "seq", "entry", "last_seq"), (own[there], *place), strict=True)})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the asked keys of each shard, from the entry where a key starts; the shard's own key decides, so no wrong one gets through."""
    for batch in batches:
        for payload, index, asked in zip(*(batch.column(c).to_pylist() for c in ("payload", "index", "asked")), strict=True):
            shard = Shard(payload, index)
            nulls = int(shard.nulls)
            for a in asked:
                at, key = max(a["at"], nulls), a["doc_id"]
                ids = []
                while at - nulls < shard.keys.size and shard.keys[at - nulls] == key:
                    ids.append(shard.entry(at))
                    at += 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * len(ids), pa.int64()), "ids": pa.array(ids, pa.binary())})


def named_only(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``table`` with a filter on the wanted values, if they are few, that reaches the scan."""
    few = [r[0] for r in wanted.select(column).distinct().limit(MOST_NAMED + 1).collect()]
    return table.where(F.col(column).isin(few)) if len(few) <= MOST_NAMED else table


def fetch_by_directory(spark: SparkSession, path: str, directory: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids (binary) of the stored documents whose id is in ``keys``, through ``write_directory``'s table; absent keys give no row.

    A key's hash names its bucket, the bucket its shard and entry: neither step looks at other keys, and of few keys only the
    files of their buckets and parts are read.
    """
    table = spark.read.schema(DIRECTORY).parquet(directory)
    first = table.select("buckets").first()
    buckets = first["buckets"] if first else 1
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    wanted = materialise(wanted, "token-keys")
    slices_ = 1 + wanted.count() // (buckets * BUCKET_KEYS)
    lists = wanted.groupBy("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(slices_)).alias("slice")).agg(F.collect_list("doc_id").alias("keys"))
    places = named_only(table, "bucket", wanted).join(lists, "bucket").select("sizes", "levels", "prints", "places", "keys").mapInArrow(_places, PLACE)
    places = materialise(places, "token-places")
    each = places.select("doc_id", "part", F.col("seq").alias("start"), "entry", F.explode(F.sequence("seq", "last_seq")).alias("seq"))
    asked = each.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", F.when(F.col("seq") == F.col("start"), F.col("entry")).otherwise(0).alias("at"))).alias("asked"))
    return named_only(shards(spark, path), "part", places).join(asked, ["part", "seq"]).select("payload", "index", "asked").mapInArrow(_entries, "doc_id long, ids binary")


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids (binary) of the stored documents whose id is in ``keys``, where there is no directory; absent keys give no row.

    Keys meet shards by an equi-join on a coarse range of ids, so neither side is broadcast.
    """
    spans = shards(spark, path).select("part", "seq", "index").mapInArrow(_span, "part int, seq long, low long, high long")
    bounds = spans.agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count("*").alias("n")).first()
    width = max(1, ((bounds["highest"] or 0) - (bounds["lowest"] or 0)) // max(1, bounds["n"]) + 1)
    cell = lambda c: F.floor(c / width)
    near = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("cell", cell(F.col("doc_id")))
    lists = wanted.join(near, "cell").where(F.col("doc_id").between(F.col("low"), F.col("high"))).groupBy("part", "seq").agg(F.collect_set("doc_id").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, index, own in zip(*(batch.column(c).to_pylist() for c in ("payload", "index", "keys")), strict=True):
                shard = Shard(payload, index)
                found = [(k, shard.entry(n)) for k, at in zip(own, shard.find(np.array(own, np.int64)), strict=True) for n in at]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.binary())})

    return shards(spark, path).join(lists, ["part", "seq"]).select("payload", "index", "keys").mapInArrow(run, "doc_id long, ids binary")


def _span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(p, s, k.min(), k.max()) for p, s, i in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "index")), strict=True) if (k := Shard(b"", i).keys).size]
        yield pa.RecordBatch.from_arrays([pa.array([int(x[n]) for x in own], t) for n, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "low", "high"])


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"

"""Alignment of two tokenizers over the same texts, by lockstep merging.

Each text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Where tokens of both end
at one byte, the text is cut, and the two tokens are linked. All documents of a batch are merged at once: one state
vector holds a pointer into the A ends and one into the B ends for each of them; a step moves every pointer whose token ends
first, or both and emits a link, and documents that are done leave the vector. Long documents are laid out as stretches of
STRETCH A tokens, whose first B token is found by bisection, so the steps are bounded however long a text is.

An id pair's count is the number of links that hold it, over all documents. The HELD most frequent pairs are broadcast;
the links of all others are joined with their counts by shuffle, so every link gets its whole count.

Defined cases: null and empty texts, and those that a vocabulary doesn't give back byte by byte, have no tokens: zeros and an empty hash.
Special tokens' strings are plain text. Repeated rows each count, and each get a row. A null id stays null. An empty table gives an empty
result. Texts of any length are read whole. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from cratewise.llm.common import materialise, texts
from cratewise.llm.token_shards import UNEVEN_SPACE, encoder

#: A tokens that are merged as one stretch.
STRETCH = 64
#: Bytes of text that are merged together, but for a longer text.
SLICE_BYTES = 1 << 19
#: Pairs that are broadcast (24 bytes each).
HELD = 1_000_000
#: Words of either vocabulary that a worker keeps encoded, at about 200 bytes each.
KEPT_WORDS = 150_000
B_BITS = 31
MARK = "▁"


def piece_bytes(model: SentencePieceProcessor, n: int) -> bytes:
    piece = model.id_to_piece(n)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace(MARK, " ").encode()


class Pieces:
    """Encodes texts by the piece vocabulary; words that single spaces part are encoded once, if no piece reaches across a space."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = [piece_bytes(self.model, n) for n in range(self.model.get_piece_size())]
        self.apart = not any(MARK in self.model.id_to_piece(n).lstrip(MARK) for n in range(len(self.bytes_of)))
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]

    def _even(self, docs: pa.Array) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = pc.split_pattern(docs, " ")
        words = split.flatten().dictionary_encode()
        spelled = words.dictionary.to_pylist()
        new = [w for w in spelled if w not in self.known]
        made = self.model.encode(new, num_threads=1)
        packed, ends = np.fromiter(chain.from_iterable(made), np.int32).tobytes(), [0, *accumulate(4 * len(x) for x in made)]
        self.known.update(zip(new, (packed[a:b] for a, b in pairwise(ends)), strict=True))
        own = list(map(self.known.__getitem__, spelled))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(own), np.int32)
        at = words.indices.to_numpy()
        each = size[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(start[at] - (ends - each), each) + np.arange(ends[-1])]
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        return np.split(ids, np.concatenate([[0], ends])[first[1:-1]])

    def batch(self, docs: pa.Array) -> list[np.ndarray]:
        """Ids of each text. One with odd white space is encoded as a whole."""
        odd = pc.match_substring_regex(docs, f"{UNEVEN_SPACE}|^ | $|^$")
        out: list[np.ndarray | None] = [None] * len(docs)
        for some, encode in ((odd, lambda x: self._encode(x.to_pylist())), (pc.invert(odd), self._even)) if self.apart else ((pc.is_valid(docs), lambda x: self._encode(x.to_pylist())),):
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if at.size:
                for k, ids in zip(at.tolist(), encode(docs.take(pa.array(at))), strict=True):
                    out[k] = ids
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Spelled:
    """Bytes of each id, and its decimal digits with room for a sign behind them."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.size = np.array(list(map(len, bytes_of)), np.int64)
        numbers = np.arange(len(bytes_of))
        self.digits = np.char.str_len(numbers.astype(str)).astype(np.int64)
        width = int(self.digits.max(initial=1)) + 1
        self.table = np.zeros((len(bytes_of), width), np.uint8)
        for column in range(width - 1):
            place = self.digits - 1 - column
            self.table[:, column] = np.where(place >= 0, 48 + numbers // 10 ** np.maximum(place, 0) % 10, 0)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> tuple[Spelled, Spelled]:
    library = encoder(path_a, True).library
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    entries = [library.id_to_token(n) or "" for n in range(library.get_vocab_size())]
    decoded = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entries]
    return Spelled(decoded), Spelled(pieces(path_b).bytes_of)


def merged(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and of the B tokens that end together, in order. ``first``: the A tokens that documents begin with; ends
    run on from document to document, and both vocabularies reach each document's end."""
    size = np.diff(np.append(first, ends_a.size))
    parts = -(-size // STRETCH)
    a = np.repeat(first, parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(a + STRETCH, np.repeat(first + size, parts))
    b = np.searchsorted(ends_b, np.where(a > 0, ends_a[a - 1], 0), "right")
    partner = np.full(ends_a.size, -1, np.int64)
    while a.size:
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        partner[a[cut]] = b[cut]
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        left = a < stop
        if not left.all():
            a, b, stop = a[left], b[left], stop[left]
    linked = np.flatnonzero(partner >= 0)
    return linked, partner[linked]


def groups_text(ids: tuple[np.ndarray, np.ndarray], links: tuple[np.ndarray, np.ndarray], spelled: tuple[Spelled, Spelled], docs: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document. ``docs``: how many tokens of both kinds each has."""
    width = max(s.table.shape[1] for s in spelled)
    total = ids[0].size + ids[1].size
    table, size, sign = np.zeros((total, width), np.uint8), np.zeros(total, np.int64), np.zeros(total, np.uint8)
    for own, (mine, other), s, last in zip(ids, (links, links[::-1]), spelled, b"|;", strict=True):
        ends = np.zeros(own.size, bool)
        ends[mine] = True
        group = np.cumsum(ends) - ends
        # before a group stand the other kind's tokens of earlier groups, and before its B tokens its A tokens too
        before = np.concatenate([[0], other + 1])[group + (last == ord(";"))]
        at = np.arange(own.size) + before
        table[at, : s.table.shape[1]], size[at], sign[at] = s.table[own], s.digits[own], np.where(ends, last, ord(","))
    table[np.arange(total), size] = sign
    flat = table[np.arange(width) <= size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(docs)])].tolist()
    return [flat[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        yield batch.slice(at, n := max(most - at, 1))
        at += n


def cut_up(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the A and B ids of the links of each document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = encoder(path_a, True), pieces(path_b)
        spelled = vocabularies(path_a, path_b)
        none = np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                text = batch.column(1)
                if sum(map(len, first.slots)) > KEPT_WORDS:
                    first.forget()
                spaced = pc.binary_join_element_wise(pa.scalar("", text.type), text, pa.scalar(" ", text.type))
                want = spaced.to_pylist()
                both = []
                for k, own in enumerate(zip(first.batch(spaced), second.batch(text), strict=True)):
                    own = tuple(x.astype(np.int64) for x in own)
                    data = want[k].encode()
                    both.append(own if len(data) > 1 and all(s.joined(x) == data for s, x in zip(spelled, own, strict=True)) else (none, none))
                ids = tuple(np.concatenate(x) for x in zip(*both, strict=True))
                n_a, n_b = (np.array([x.size for x in own], np.int64) for own in zip(*both, strict=True))
                ends_a, ends_b = (np.cumsum(s.size[x]) for s, x in zip(spelled, ids, strict=True))
                some = n_a > 0
                links = merged(ends_a, ends_b, (np.cumsum(n_a) - n_a)[some])
                shown = groups_text(ids, links, spelled, n_a + n_b)
                ends = np.searchsorted(links[0], np.cumsum(n_a))
                n = pa.array(np.diff(ends, prepend=0))
                hashes = pa.array([hashlib.sha256(x).hexdigest() if t else "" for x, t in zip(shown, some, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_a), pa.array(n_b), n, n, hashes, cut_up(ends, ids[0][links[0]]), cut_up(ends, ids[1][links[1]])], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "alignment-links", compression="zstd")


def links_of(rows: DataFrame) -> DataFrame:
    """row, code: each link with its pair of ids as one number."""
    pair = F.explode(F.arrays_zip("a", "b")).alias("x")
    return rows.select("row", pair).select("row", F.shiftleft(F.col("x.a").cast("long"), B_BITS).bitwiseOR(F.col("x.b").cast("long")).alias("code"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """code, a, b, n, best: how many links hold each pair of ids, and whether no pair of its B id has more. Links are counted in each task before any is sent."""
    pairs = links_of(rows).groupBy("code").agg(F.count("*").alias("n"))
    pairs = materialise(pairs.withColumn("b", F.col("code").bitwiseAND((1 << B_BITS) - 1).cast("int")), "alignment-pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # one row an id of the vocabulary
    return pairs.join(F.broadcast(most), "b").select("code", F.shiftright("code", B_BITS).cast("int").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def sums(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, n_best, count_sum over all links of each row."""
    pairs = pairs.select("code", "n", F.col("best").cast("long").alias("best"))
    held = materialise(pairs.orderBy(F.desc("n"), "code").limit(HELD), "alignment-held")
    links = links_of(rows)
    added = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    found = links.join(F.broadcast(held), "code").groupBy("row").agg(*added)
    if held.count() < HELD:
        return found
    rest = links.join(F.broadcast(held.select("code")), "code", "left_anti").groupBy("row", "code").agg(F.count("*").alias("times"))
    more = rest.join(pairs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document; and the counts of all pairs (code, a, b, n, best)."""
    rows = aligned(docs, path_a, path_b)
    pairs = pair_counts(rows)
    found = rows.drop("a", "b").join(sums(rows, pairs), "row", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"), pairs

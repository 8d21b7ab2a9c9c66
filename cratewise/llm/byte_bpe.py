"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that one automaton of all tokens finds every token that starts
at each byte. An encoding takes the longest token, and steps back to a shorter one (or to the token
before) when two neighbours couldn't stand side by side in a merge order. Whether two tokens may be
neighbours depends on these two alone, so the answers are memoised and each byte is tried a bounded
number of times. The idea is that of backtracking BPE encoders (published with the Rust crate ``bpe``).

A null text counts as empty, and an empty text has no ids. Rows are neither dropped nor merged, in any
order of input; columns other than doc_id and text are ignored. An empty table gives an empty result. A text
of any length is encoded whole, its working memory is in proportion to its longest match of the pattern.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import texts

#: Bytes that a worker's encoded chunks may take; it forgets all of them beyond, and at the end of each task.
CACHE_BYTES = 64 << 20
#: What a cached chunk takes besides its characters and ids: two objects and a place in a table.
ENTRY_BYTES = 190
#: Answers on neighbours that are kept, of about 100 bytes.
CACHE_PAIRS = 200_000
#: Texts that are encoded at once.
SLICE = 500
#: Longer chunks are encoded each time.
CACHE_CHARS = 200
#: Where a single space parts two words, the splitting pattern never looks across it. Elsewhere it may.
UNEVEN_SPACE = re.compile(r" \s|\s ")


class Known(dict):
    """Encoded strings by string; what is missing is encoded, and kept if it is short. ``held`` bytes are kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(text) <= CACHE_CHARS:
            self[text] = ids
            self.held += ENTRY_BYTES + len(text) + len(ids)
        return ids

    def clear(self) -> None:
        super().clear()
        self.held = 0


class ByteBpe:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.words = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size_of = [0] * (max(self.bytes_of, default=-1) + 1)
        self.shorter: list[int | None] = [None] * len(self.size_of)
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[int, bool] = {}
        self.matches = Known(lambda match: array("I", self.word(match.encode())).tobytes())
        self.first = Known(self._chunk)
        self.later = Known(lambda chunk: self._chunk(" " + chunk))

    def halves(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes a token; None for a single byte."""
        if token not in self._halves:
            data, found = self.bytes_of[token], None
            left = self.shorter[token]  # the longest token that is a proper prefix
            while left is not None and found is None:
                right = self.ranks.get(data[len(self.bytes_of[left]) :])
                if right is not None and left < token and right < token and self._stand(left, right, token):
                    found = left, right
                left = self.shorter[left]
            self._halves[token] = found
        return self._halves[token]

    def _stand(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border of two neighbours.

        The younger of both is opened again and again, as it was made last: before that merge, the part at
        the border stood there, and a merge across the border with a lower rank would have come first.
        """
        while True:
            both = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if both is not None and both < limit and self.halves(both) == (left, right):
                return False
            if left > right:
                limit, parts = left, self.halves(left)
                if parts is not None:
                    left = parts[1]
                    continue
                limit, parts = right + 1, self.halves(right)
                if parts is None:
                    return True
                right = parts[0]
            else:
                limit, parts = right + 1, self.halves(right)
                if parts is not None:
                    right = parts[0]
                    continue
                limit, parts = left, self.halves(left)
                if parts is None:
                    return True
                left = parts[1]

    def word(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, sizes, shorter, beside = len(data), self.size_of, self.shorter, self._beside
        longest = [0] * (n + 1)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end - sizes[token] + 1] = token  # ends ascend, so the longest stays
        shut: set[int] = set()
        ids: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            fits = not shut or end not in shut
            if fits and last >= 0:
                pair = last << 32 | token
                if (fits := beside.get(pair)) is None:
                    if len(beside) > CACHE_PAIRS:
                        beside.clear()
                    fits = beside[pair] = self._stand(last, token, float("inf"))
            if fits:
                ids.append(token)
                if end == n:
                    return ids
                at, last, token = end, token, longest[end]
            elif (less := shorter[token]) is not None:
                token = less
            else:
                shut.add(at)
                token = ids.pop()
                at -= sizes[token]
                last = ids[-1] if ids else -1

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.later.held + self.first.held + self.matches.held > CACHE_BYTES:
            self.forget()
        if UNEVEN_SPACE.search(text):
            return self._chunk(text)
        first, *others = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, others))

    def forget(self) -> None:
        """Drop what is cached of texts; the table of tokens stays."""
        for known in (self.later, self.first, self.matches, self._beside):
            known.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of each text. Each worker loads the table once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in sliced(batches):
            ids = [bpe.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        bpe.forget()

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text of each row of ids; bytes that are no UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in batches:
            text = [bpe.decode(ids or b"").decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding each text and decoding its ids again gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in sliced(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").select(F.col("*"))

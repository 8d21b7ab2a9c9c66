"""All texts of two blocks compared 64 at a time: a word holds one bit of each of 64 texts, its lanes.

Two texts' table of common subsequences grows by 0 or 1 from cell to cell, so a step from one antidiagonal to the next is four operations on
words for all lanes, and only diagonals that few unmatched characters reach are stepped through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Words of lanes that are compared at once, of a diagonal's lanes for some texts, and of a table of characters; kinds of characters told apart;
#: pairs whose edits are told at once.
WORDS, ROW, TABLE, KINDS, PAIRS = 32, 2048, 2**22, 63, 4096

#: For lengths of two texts: the characters that must be matched in order, more than either has if the lengths rule it out; and how many
#: characters more of the first, or of the second, may have been read at any time.
Rule = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of character codes, from 1 by frequency and 0 where they have ended, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, at, times = np.unique(own, return_inverse=True, return_counts=True)
    rank = np.empty(known.size, np.int32)
    rank[np.argsort(-times, kind="stable")] = np.arange(1, known.size + 1)
    codes = np.zeros((size.size, int(size.max(initial=0))), np.int32)
    codes[np.arange(codes.shape[1]) < size[:, None]] = rank[at]
    return codes, size


def planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Numbers (one a lane, lanes a multiple of 64) as words of their lowest bits, next bits and so on."""
    held = (numbers[..., None, :] >> np.arange(bits)[:, None] & 1).astype(bool)
    return np.packbits(held, axis=-1, bitorder="little").view(np.uint64)


def table(codes: np.ndarray, kinds: int) -> np.ndarray:
    """Words by character code and place (from 1) that tell which lanes have it there; none of them has code 0, or place 0."""
    lanes, length = codes.shape
    words = np.zeros((kinds, length + 1, -(-lanes // 64)), np.uint64)
    padded = np.zeros((length, words.shape[2] * 64), codes.dtype)
    padded[:, :lanes] = codes.T
    for c in range(1, kinds):
        words[c, 1:] = np.packbits(padded == c, axis=1, bitorder="little").view(np.uint64)
    return words


def added(rows: np.ndarray) -> list[np.ndarray]:
    """The sum of rows of bits, lane by lane, as words of its lowest bits, next bits and so on."""
    out = []
    while len(rows):
        carried = []
        while len(rows) > 1:
            n = len(rows) // 3
            if n:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                half = a ^ b
                carried.append(a & b | half & c)
                rows = np.concatenate([half ^ c, rows[3 * n :]])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return out


@lru_cache(maxsize=256)
def walk(rows: int, length: int, down: int, up: int) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice, slice, bool, int, int]]]:
    """The cells of a table in a band of diagonals (-down to up, an even number apart) by antidiagonals: their places in both texts; and of each antidiagonal
    its cells, the slots in which what grows along and across is held for them, whether it has the band's own ends, and the row and cell of the last diagonal."""
    end, steps, cells, p, q = length - rows, [], 0, [], []
    for step in range(2, rows + length + 1):
        inner = (step + down) & 1
        d = np.arange(inner - down, up - inner + 1, 2)
        at = np.flatnonzero((step - d >= 2) & (step - d <= 2 * rows) & (step + d >= 2) & (step + d <= 2 * length))
        if at.size:
            first, last, d = int(at[0]), int(at[-1]) + 1, d[at]
            p.append((step - d) // 2)
            q.append((step + d) // 2)
            row = (step - end) // 2 if not (step - end) & 1 else 0
            steps.append((slice(cells, cells + d.size), slice(first + inner, last + inner), slice(first, last), not inner, row if max(1, 1 - end) <= row <= rows else 0, (end - int(d[0])) // 2))
            cells += d.size
    return np.concatenate(p).astype(np.int16), np.concatenate(q).astype(np.int16), steps


def matched(first: np.ndarray, words: np.ndarray, down: int, up: int) -> list[np.ndarray]:
    """How many characters of each first text and each lane can be matched in order, as sums of bits; at any time at most
    ``down`` characters more of the first are read than of the other, and ``up`` fewer."""
    count, rows = first.shape
    length, width = words.shape[1] - 1, words.shape[2]
    down, up = max(down, rows - length, 0), max(up, length - rows, 0)
    up += (down + up) & 1
    p, q, steps = walk(rows, length, down, up)
    places = first.T[p - 1].astype(np.int64) * (length + 1) + q[:, None]
    flat, slots = words.reshape(-1, width), (down + up) // 2 + 1
    # what grows at the edges of cells; the cell after an edge puts there what grows at its own far edge. Outside of the band nothing grows.
    across, along, here = (np.zeros((slots, count, width), np.uint64) for _ in range(3))
    grown = np.zeros((rows, count, width), np.uint64)
    for cells, low, high, ends, row, cell in steps:
        m, x, y = here[: cells.stop - cells.start], across[low], along[high]
        flat.take(places[cells], axis=0, out=m, mode="clip")
        np.bitwise_or(m, x, out=m)
        np.bitwise_or(m, y, out=m)
        if row:
            grown[row - 1] = m[cell]
        if ends and low.start == 0:
            np.bitwise_xor(x[1:], m[1:], out=x[1:])
        else:
            np.bitwise_xor(x, m, out=x)
        if ends and high.stop == slots:
            np.bitwise_xor(y[:-1], m[:-1], out=y[:-1])
        else:
            np.bitwise_xor(y, m, out=y)
    return added(grown)


def alike(codes: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a low and a high text that match in as many characters as the rule asks for, and may be like; a text of both
    is compared once with each other one. Texts go by length, so that lanes and rows end together."""
    low, high = (np.flatnonzero(x)[np.argsort(size[x], kind="stable")] for x in (low, high))
    rank = np.full(size.size, -1)
    rank[high] = np.arange(high.size)
    length = int(size.max(initial=0))
    kinds = min(int(codes.max(initial=0)), KINDS)
    folded = np.where(codes > 0, (codes - 1) % KINDS + 1, 0)
    width = max(1, min(WORDS, TABLE // ((kinds + 1) * (length + 1))))
    for start in range(0, high.size, 64 * width):
        lanes = high[start : start + 64 * width]
        longest = int(size[lanes[-1]])
        words = table(folded[lanes, :longest], kinds + 1)
        ends = np.zeros(words.shape[2] * 64, np.int64)
        ends[: lanes.size] = size[lanes]
        # how long the low texts are decides once how much each lane must match
        bits = (length + 1).bit_length()
        asked, reach = {}, {}
        for n in np.unique(size[low]).tolist():
            least, down, up = rule(n, ends)
            able = (least <= np.minimum(n, ends)) & (ends > 0)
            if able.any():
                asked[n] = planes(np.where(able, least, 2**bits - 1), bits)
                reach[n] = int(down[able].max()), int(up[able].max())
        rows = low[np.isin(size[low], list(asked)) & (rank[low] < start + lanes.size)]
        batch = max(1, ROW // words.shape[2])
        for at in range(0, rows.size, batch):
            some = rows[at : at + batch]
            own = size[some].tolist()
            down, up = (max(reach[n][k] for n in own) for k in (0, 1))
            sums = matched(folded[some, : own[-1]], words, down, up)
            least = np.stack([asked[n] for n in own], axis=1)
            enough = np.full(least.shape[1:], 2**64 - 1, np.uint64)
            for k in range(bits):
                enough = sums[k] & ~least[k] | enough & ~(sums[k] ^ least[k]) if k < len(sums) else enough & ~least[k]
            words_of = np.flatnonzero(enough)
            found, bit = np.nonzero(np.unpackbits(enough.reshape(-1)[words_of].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, lane = np.divmod(words_of[found], words.shape[2])
            i, j = some[i], lanes[lane * 64 + bit]
            once = (rank[i] < 0) | (rank[i] < rank[j])
            yield i[once], j[once]


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], many: int = 2**15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``many`` or more at a time but for the last ones."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += pair[0].size
        if n >= many:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def edits(codes: np.ndarray, size: np.ndarray, first: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Edits between the texts of each pair, of which the first has at most 64 characters: a column of each pair's table at a time, as bits of a word."""
    out, one = np.empty(first.size, np.int64), np.uint64(1)
    own, at = np.unique(first, return_inverse=True)
    kinds = int(codes[own].max(initial=0)) + 1
    held = max(1, TABLE // kinds)
    for start in range(0, own.size, held):
        texts = codes[own[start : start + held]]
        masks = np.zeros((len(texts), kinds), np.uint64)
        for k in range(min(64, codes.shape[1])):
            masks[np.arange(len(texts)), texts[:, k]] |= one << np.uint64(k)
        masks[:, 0] = 0
        some = np.flatnonzero((at >= start) & (at < start + held))
        some = some[np.argsort(-size[other[some]], kind="stable")]
        for pairs in np.array_split(some, -(-some.size // PAIRS)):
            count, last, ends = size[first[pairs]], (size[first[pairs]] - 1).astype(np.uint64), size[other[pairs]]
            text = codes[other[pairs], : int(ends[0])].T
            text = np.where(text < kinds, text, 0) + (at[pairs] - start) * kinds
            more, less = np.full(pairs.size, ~np.uint64(0)), np.zeros(pairs.size, np.uint64)
            for k, n in enumerate(np.searchsorted(-ends, -np.arange(int(ends[0])), side="left").tolist()):
                p, m, to = more[:n], less[:n], last[:n]
                here = masks.take(text[k, :n])
                down, across = here | m, (((here & p) + p) ^ p) | here
                up, fall = m | ~(across | p), p & across
                count[:n] += (up >> to & one).astype(np.int64) - (fall >> to & one).astype(np.int64)
                up, fall = up << one | one, fall << one
                more[:n], less[:n] = fall | ~(down | up), up & down
            out[pairs] = count
    return out

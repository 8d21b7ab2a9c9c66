"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves the vectors again and again by their place along a random direction (from one vector to another one of a
sample), so each vector lies in one leaf of every tree. A query's leaves come from one priority queue that all
trees share: what it holds is ordered by the squared distance from the query to the cuts that part it from a branch, the
nearest first. Leaves are opened until they hold enough rows; then the candidates in them are ranked by exact distances.

How many rows are enough is measured: for up to PROBES queries, chosen by a hash, the true neighbours are found by a scan of
all rows, and the budget is the smallest one by which the queue reaches TARGET of them.

Only the cuts are learned from a bounded sample (SAMPLE rows, SAMPLE_BYTES at most, by a hash); every row is indexed. Leaves are
dealt out in blocks of about BLOCK rows, so many equal vectors, which no cut can part, don't meet in one task; a query
is sent to every block of its leaves.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part; nor do rows of a null id, or of
another length than the most frequent one (ties: the longer). Rows of one id aren't candidates of each other; repeated rows count
once, and of rows with equal ids and other vectors the nearest one counts as candidate and each is a query.
Ties go to the smaller id. An empty table gives an empty result. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.common import materialise

TREES = 3
#: Rows of a leaf and of a block of a leaf, about.
LEAF, BLOCK = 1_000, 4_000
#: Vectors that the cuts are learned from, their bytes (at 4 a component), and how many of them a leaf has at least.
SAMPLE, SAMPLE_BYTES, IN_LEAF = 200_000, 64 << 20, 8
#: Queries whose true neighbours set the budget, and the share of these that the queue must reach.
PROBES, TARGET = 100, 0.95
#: Queries whose margins are computed at once, and queries that meet a block at once.
TOGETHER, MEET = 64, 256


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


@dataclass
class Tree:
    """Nodes in heap order: a vector goes to the right where its product with the direction is over the cut."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def grow(cls, sample: np.ndarray, depth: int, draw: np.random.Generator) -> Tree:
        directions, cuts = draw.normal(size=((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
        members = [np.arange(len(sample))]
        for node in range(len(cuts)):
            own = members[node]
            if own.size > 1:
                one, two = sample[draw.choice(own, 2, replace=False)]
                if (one != two).any():
                    directions[node] = two - one
            directions[node] /= np.linalg.norm(directions[node])
            along = sample[own] @ directions[node]
            cuts[node] = np.median(along) if own.size else 0.0
            members[node] = None
            members += [own[along <= cuts[node]], own[along > cuts[node]]]
        return cls(directions, cuts, depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.directions[node]) > self.cuts[node])
        return node - ((1 << self.depth) - 1)


@dataclass
class Forest:
    trees: list[Tree]
    counts: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    budget: int

    @classmethod
    def grow(cls, sample: np.ndarray, depth: int) -> Forest:
        trees = [Tree.grow(sample, depth, np.random.default_rng(11 + n)) for n in range(TREES if depth else 1)]
        none = np.zeros((len(trees), 1 << depth), np.int64)
        return cls(trees, none, none, none, 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.leaves(x) for t in self.trees], axis=1)

    def counted(self, counts: np.ndarray) -> None:
        self.counts, self.blocks = counts, np.maximum(1, -(-counts // BLOCK))
        self.first = (np.cumsum(self.blocks) - self.blocks.ravel()).reshape(counts.shape)

    def opened(self, queries: np.ndarray) -> Iterator[Iterator[tuple[int, int]]]:
        """For each query its (tree, leaf) pairs in the order of the queue that all trees share."""
        for at in range(0, len(queries), TOGETHER):
            margins = [queries[at : at + TOGETHER] @ t.directions.T - t.cuts for t in self.trees]
            for n in range(len(queries[at : at + TOGETHER])):
                yield self._opened([m[n].tolist() for m in margins])

    def _opened(self, margins: list[list[float]]) -> Iterator[tuple[int, int]]:
        inner = len(margins[0])
        queue = [(0.0, tree, 0) for tree in range(len(margins))]
        while queue:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree][node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (cost + margin * margin, tree, 4 * node + 3 - near))
                node = near
            yield tree, node - inner

    def visits(self, queries: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """The leaves of each query until they hold as many rows as the budget says."""
        for order in self.opened(queries):
            found, held = [], 0
            for tree, leaf in order:
                found.append((tree, leaf))
                held += int(self.counts[tree, leaf])
                if held >= self.budget:
                    break
            yield found

    def reached(self, query: np.ndarray, leaves: np.ndarray) -> list[int]:
        """After how many rows the queue opens a leaf that holds each neighbour (a row of ``leaves``: its leaf in every tree)."""
        held, at = 0, {}
        for tree, leaf in next(self.opened(query[None])):
            held += int(self.counts[tree, leaf])
            at[tree, leaf] = held
        return [min(at[pair] for pair in enumerate(row)) for row in leaves.tolist()]


def nearest_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and exact distances of its k nearest vectors but those of its own id, ties by id. Products only choose whom to measure."""
    lengths = np.einsum("ij,ij->i", vectors, vectors)
    squares = lengths - 2 * (queries @ vectors.T) + np.einsum("ij,ij->i", queries, queries)[:, None]
    squares[own[:, None] == ids] = np.inf
    slack = 1e-9 * (lengths.max(initial=0.0) + np.einsum("ij,ij->i", queries, queries))
    out = []
    for n, row in enumerate(squares):
        most = np.partition(row, k - 1)[k - 1] if row.size > k else np.inf
        at = np.flatnonzero((row <= most + slack[n]) & (row < np.inf))
        exact = np.sqrt(((vectors[at] - queries[n]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact))
        at, exact = at[order], exact[order]
        new = np.sort(np.unique(ids[at], return_index=True)[1])[:k]
        out.append((at[new], exact[new]))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False)))


def top(pairs: DataFrame, k: int, *query: str) -> DataFrame:
    """The k nearest vec_id of each query, with rank, from (query, vec_id, score) rows."""
    each = pairs.groupBy(*query, "vec_id").agg(F.min_by(F.struct(*(c for c in pairs.columns if c not in (*query, "vec_id"))), "score").alias("own"))
    rank = F.row_number().over(Window.partitionBy(*query).orderBy("own.score", "vec_id"))
    return each.select(*query, "vec_id", "own.*", rank.alias("rank")).where(F.col("rank") <= k)


def row_counts(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of each leaf, by tree."""
    held, width = rows.sparkSession.sparkContext.broadcast(forest), forest.counts.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(held.value.counts.size, np.int64)
        for batch in batches:
            leaves = held.value.leaves(matrix(batch.column(0))) + width * np.arange(len(held.value.trees))
            total += np.bincount(leaves.ravel(), minlength=total.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(forest.counts.size, np.int64)
    for r in rows.select("embedding").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts.reshape(forest.counts.shape)


def true_neighbours(rows: DataFrame, probes: pa.Table, forest: Forest, k: int) -> DataFrame:
    """probe, vec_id, score, leaves, rank: the k nearest rows of each probe, by a scan of all rows."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast((forest, probes.column("vec_id").to_numpy(), matrix(probes.column("embedding").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, own, queries = held.value
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            for n, (at, exact) in enumerate(nearest_of(queries, ids, vectors, own, k)):
                rows = zip(exact.tolist(), ids[at].tolist(), forest.leaves(vectors[at]).tolist(), strict=True)
                best[n] = heapq.nsmallest(2 * k, [*best[n], *rows])
        flat = [(n, *row) for n, rows in enumerate(best) for row in rows]
        columns = list(zip(*flat, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["probe", "score", "vec_id", "leaves"])

    return top(rows.mapInArrow(run, "probe int, score double, vec_id long, leaves array<long>"), k, "probe")


def fit(rows: DataFrame, asked: Column, k: int) -> Forest | None:
    """A forest for usable rows of one length."""
    total = rows.count()
    if not total:
        return None
    width = rows.select(F.size("embedding")).first()[0]
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    sample = matrix(rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(most).select("embedding").toArrow().column(0).combine_chunks())
    depth = max(0, min(int(np.ceil(np.log2(total / LEAF))), int(np.log2(max(1, len(sample) / IN_LEAF)))))
    forest = Forest.grow(sample, depth)
    forest.counted(row_counts(rows, forest))
    forest.budget = int(forest.counts.sum())
    if depth:
        probes = rows.where(asked).orderBy(F.xxhash64("vec_id", "embedding", F.lit(1)), "vec_id").limit(PROBES).toArrow()
        found = true_neighbours(rows, probes, forest, k).toArrow().to_pydict() if len(probes) else {"probe": []}
        queries = matrix(probes.column("embedding").combine_chunks()) if len(probes) else None
        probe, reached = np.array(found["probe"], int), []
        for n in np.unique(probe):
            reached += forest.reached(queries[n], np.array([x for x, p in zip(found["leaves"], found["probe"], strict=True) if p == n]))
        if reached:
            forest.budget = max(TREES * LEAF, int(np.quantile(reached, TARGET, method="higher")))
    return forest


def nearest(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``asked`` (over vec_id) admits, by Euclidean distance."""
    rows = usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    rows = rows.where(F.size("embedding") == (common[0]["width"] if common else -1)).withColumn("vec_id", F.col("vec_id").cast("long"))
    forest = fit(rows, asked, k)
    kind = rows.schema["embedding"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(forest)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for every tree, with its block."""
        for batch in batches:
            forest = held.value
            leaves = forest.leaves(matrix(batch.column(1)))
            for tree in range(leaves.shape[1]):
                blocks, first = forest.blocks[tree][leaves[:, tree]], forest.first[tree][leaves[:, tree]]
                at = first + batch.column(2).to_numpy() % blocks
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["at", "id", "embedding", "h"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block of its leaves."""
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch, forest = whole.slice(start, TOGETHER), held.value
                blocks = [[forest.first[t, leaf] + b for t, leaf in own for b in range(forest.blocks[t, leaf])] for own in forest.visits(matrix(batch.column(1)))]
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, blocks)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks).astype(np.int64)), *taken.columns], ["at", "id", "embedding", "h"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order of block, its vectors before its queries."""
        block, ids, parts = None, [], []
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in bounds(at, asks):
                own = batch.slice(a, b - a)
                if at[a] != block:
                    block, ids, parts = at[a], [], []
                if not asks[a]:
                    ids.append(own.column(2).to_numpy())
                    parts.append(matrix(own.column(3)))
                    continue
                if len(parts) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                for start in range(0, own.num_rows if parts else 0, MEET):
                    some = own.slice(start, MEET)
                    found = nearest_of(matrix(some.column(3)), ids[0], parts[0], some.column(2).to_numpy(), k)
                    query = np.repeat(np.arange(some.num_rows), [x.size for x, _ in found])
                    places, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(query)), some.column(4).take(pa.array(query)), pa.array(ids[0][places]), pa.array(scores)], ["query_id", "h", "vec_id", "score"])

    keyed = rows.withColumn("h", F.xxhash64("vec_id", "embedding").bitwiseAND((1 << 62) - 1))
    schema = f"at long, id long, embedding {kind}, h long"
    vectors_of = keyed.mapInArrow(dealt, schema).withColumn("asks", F.lit(False))
    queries_of = keyed.where(asked).dropDuplicates(["vec_id", "h"]).mapInArrow(sent, schema).withColumn("asks", F.lit(True))
    both = vectors_of.unionByName(queries_of).select("at", "asks", "id", "embedding", "h").repartition("at").sortWithinPartitions("at", "asks")
    found = materialise(both.mapInArrow(ranked, "query_id long, h long, vec_id long, score double"), "forest-found")
    return top(found, k, "query_id", "h").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def bounds(at: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal blocks and kinds."""
    cut = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), at.size], strict=True)) if at.size else []

"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are cut into two halves, each quantised by a codebook of its own; a pair of centroids is a cell. A query takes
cells in order of summed distance, with a heap over the two sorted halves, until the cells hold as many entries as its
budget says, and reranks their entries by the inner product of the whole vectors. A centroid's distance is how much less
its inner product with the query's half is than that of the half's best centroid.

The codebooks are fitted on SAMPLE vectors; every vector is indexed. The budget is measured: PROBES queries are compared
with all entries, and the place of each true neighbour's cell in the query's traversal says which budget finds it; the
least by which TARGET of them are found is taken.

Entries are dealt into blocks: runs of cells of about BLOCK entries, one large cell over several blocks by a hash. In a
block's task its entries are held and queries stream by; a block that many queries visit is copied for each ASIDE of
them. Only the sample, the probes' neighbours and the counts by cell reach the driver.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id; rows equal in id and vector are one, and rows that share an id are no candidates of each other;
equal products go by the smaller id; a query with fewer candidates than asked for gets all within its budget; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy

SAMPLE, ROUNDS = 20_000, 10
PROBES, TARGET = 256, 0.96
#: Centroids a half: about CELL_ROWS entries a cell, between these bounds; cells are the square.
CELL_ROWS, FEWEST, MOST = 12, 4, 256
BLOCK, ASIDE = 4096, 100_000
#: Queries whose products with a block's entries are held at once.
AT_ONCE = 128


@dataclass(frozen=True)
class Index:
    """Two codebooks of k centroids each, and the number of entries of each cell (first centroid * k + second)."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.half], self.left) * len(self.right) + nearest(vectors[:, self.half :], self.right)

    def traverse(self, query: np.ndarray) -> Iterator[int]:
        """All cells with an entry, by growing sum of the halves' distances."""
        near, far = self.left @ query[: self.half], self.right @ query[self.half :]
        rows, columns = np.argsort(-near, kind="stable"), np.argsort(-far, kind="stable")
        a, b = (near[rows[0]] - near[rows]).tolist(), (far[columns[0]] - far[columns]).tolist()
        rows, columns, k, held = rows.tolist(), columns.tolist(), len(self.right), self.counts
        heap = [(0.0, 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * k + columns[j]
            if held[cell]:
                yield cell
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def visited(self, query: np.ndarray, budget: int) -> np.ndarray:
        """The first cells that together hold budget entries, or all."""
        out, n = [], 0
        for cell in self.traverse(query):
            if n >= budget:
                break
            out.append(cell)
            n += self.counts[cell]
        return np.array(out, np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each point, the centroid at the least Euclidean distance."""
    out, norms = np.empty(len(points), np.int64), (centroids * centroids).sum(1) / 2
    for i in range(0, len(points), 4096):
        out[i : i + 4096] = np.argmax(points[i : i + 4096] @ centroids.T - norms, axis=1)
    return out


def codebook(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to k centroids of points by Lloyd's rounds; fewer where fewer points differ."""
    points = np.unique(points, axis=0)
    centroids = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(ROUNDS):
        of = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, points)
        sizes = np.bincount(of, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, once each."""
    v = F.col("vector")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL")
    rows = rows.where(whole & F.exists(v, lambda x: x != 0)).distinct()
    return rows


def index(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index and its entries (vec_id, vector, cell), written; None if there are no rows."""
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if width is None:
        return None
    rows = materialize(rows.where(F.size("vector") == width["n"]))
    n = rows.count()
    sample = matrix([r.vector for r in rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("vector").collect()])
    k = int(min(MOST, max(FEWEST, round((n / CELL_ROWS) ** 0.5))))
    half = (width["n"] + 1) // 2
    left, right = codebook(sample[:, :half], k, 1), codebook(sample[:, half:], k, 2)
    made = Index(left, right, np.zeros(len(left) * len(right), np.int64))
    small_batches(rows.sparkSession)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=made.cells(matrix(batch["vector"])))
        tidy()

    kind = rows.schema["vector"].dataType.simpleString()
    entries = materialize(rows.mapInPandas(put, f"vec_id long, vector {kind}, cell long"))
    for r in entries.groupBy("cell").count().collect():  # one row a cell, MOST squared at most
        made.counts[r["cell"]] = r["count"]
    return made, entries


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components."""
    out = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        out += query[:, j] * vectors[:, j]
    return out


def best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, entry's place, score) of each query's k best entries, ties by the smaller id; only those allowed, and none of the query's own id."""
    rough = queries @ vectors.T
    open_ = q_ids[:, None] != ids[None, :]
    if allowed is not None:
        open_ &= allowed
    rough[~open_] = -np.inf
    if rough.shape[1] > k:
        kth = np.partition(rough, -k, axis=1)[:, -k]
        # the matrix product may be off in its last digits
        slack = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0)
        open_ &= rough >= (kth - slack)[:, None]
    of, at = np.nonzero(open_)
    score = exact(queries[of], vectors[at])
    order = np.lexsort((ids[at], -score, of))
    of, at, score = of[order], at[order], score[order]
    heads = np.searchsorted(of, np.arange(len(queries)))
    keep = np.arange(len(of)) - heads[of] < k
    return of[keep], at[keep], score[keep]


def top(found: DataFrame, k: int, *also: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *also)


def compared(entries: DataFrame, q_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, cell): the k best of all entries for a bounded number of queries, exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "cell": []}).astype({"query_id": "int64", "vec_id": "int64", "cell": "int64"})
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = batch.iloc[low : low + BLOCK]
                of, at, score = best(q_ids, queries, part["vec_id"].to_numpy(), matrix(part["vector"]), k)
                more = pd.DataFrame({"query_id": q_ids[of], "vec_id": part["vec_id"].to_numpy()[at], "score": score, "cell": part["cell"].to_numpy()[at]})
                held = pd.concat([held, more]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield held
        tidy()

    return top(entries.mapInPandas(run, "query_id long, vec_id long, score double, cell long"), k, "cell")


def budget(made: Index, entries: DataFrame, asked: Column, k: int, target: float = TARGET) -> int:
    """The least number of entries that finds target of the true neighbours of PROBES queries."""
    chosen = entries.where(asked).orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(PROBES).select("vec_id", "vector").collect()
    if not chosen:
        return 0
    chosen = list({r.vec_id: r for r in chosen}.values())
    queries = matrix([r.vector for r in chosen])
    true = compared(entries, np.array([r.vec_id for r in chosen], np.int64), queries, k).select("query_id", "cell").collect()
    before = {}
    for r, q in zip(chosen, queries, strict=True):
        cells = np.fromiter(made.traverse(q), np.int64)
        held = made.counts[cells]
        before[r.vec_id] = dict(zip(cells.tolist(), (np.cumsum(held) - held).tolist(), strict=True))
    needed = sorted(before[r.query_id][r.cell] + 1 for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 0


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its first block and its number of blocks: neighbouring cells share one of about BLOCK entries."""
    first, n = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block = filled = 0
    for cell in np.flatnonzero(counts):
        if filled and filled + counts[cell] > BLOCK:
            block, filled = block + 1, 0
        first[cell], n[cell] = block, max(1, -(-counts[cell] // BLOCK))
        filled += counts[cell]
        block += n[cell] - 1
    return first, n


def _deal(made: Index, spent: int, aside: int, kind: str) -> tuple[Callable, Callable, str]:
    first, n = blocks_of(made.counts)
    schema = f"block long, aside int, is_query boolean, id long, vector {kind}, cells array<long>"

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = batch["cell"].to_numpy()
            block = first[cell] + batch["salt"].to_numpy() % n[cell]
            for i in range(aside):
                yield pd.DataFrame({"block": block, "aside": i, "is_query": False, "id": batch["vec_id"], "vector": batch["vector"], "cells": [[c] for c in cell.tolist()]})

    def queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), AT_ONCE):
                rows = []
                part = batch.iloc[low : low + AT_ONCE]
                for id_, vector, salt in zip(part["vec_id"], part["vector"], part["salt"], strict=True):
                    cells = made.visited(np.asarray(vector, np.float64), spent)
                    # a cell of several blocks is visited in each
                    block = np.repeat(first[cells], n[cells]) + np.concatenate([np.arange(m) for m in n[cells]] or [cells])
                    cells = np.repeat(cells, n[cells])
                    order = np.argsort(block, kind="stable")
                    block, cells = block[order], cells[order]
                    cuts = np.flatnonzero(np.diff(block)) + 1
                    rows += [(b[0], salt % aside, True, id_, vector, c) for b, c in zip(np.split(block, cuts), np.split(cells, cuts), strict=True) if len(b)]
                yield pd.DataFrame(rows, columns=["block", "aside", "is_query", "id", "vector", "cells"])
        tidy()

    return entries, queries, schema


def _meet(k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, parts, ids, vectors, cells = None, [], None, None, None
        for batch in batches:
            keys = batch["block"].to_numpy() * (1 << 20) + batch["aside"].to_numpy()
            kinds = batch["is_query"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds.astype(int)) != 0)) + 1), len(batch)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                run_ = batch.iloc[low:high]
                if keys[low] != here:
                    here, parts, ids = keys[low], [], None
                if not kinds[low]:
                    parts.append((run_["id"].to_numpy(), matrix(run_["vector"]), np.array([c[0] for c in run_["cells"]], np.int64)))
                    ids = None
                    continue
                if not parts:
                    continue
                if ids is None:
                    ids, vectors, cells = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    parts = [(ids, vectors, cells)]
                    names, place = np.unique(cells, return_inverse=True)
                for at in range(0, len(run_), AT_ONCE):
                    some = run_.iloc[at : at + AT_ONCE]
                    q_ids = some["id"].to_numpy()
                    allowed = np.zeros((len(some), len(names) + 1), bool)
                    for i, c in enumerate(some["cells"]):
                        spots = np.minimum(np.searchsorted(names, c), len(names) - 1)
                        allowed[i, spots[names[spots] == c]] = True
                    of, to, score = best(q_ids, matrix(some["vector"]), ids, vectors, k, allowed[:, place])
                    yield pd.DataFrame({"query_id": q_ids[of], "vec_id": ids[to], "score": score})
        tidy()

    return run


def search(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id every divides, its k nearest found among all other rows."""
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    found = index(usable(df, vec_id, vector))
    if found is None:
        return spark.createDataFrame([], schema)
    made, entries = found
    asked = F.pmod("vec_id", F.lit(every)) == 0
    spent = budget(made, entries, asked, k, target)
    aside = max(1, -(-entries.where(asked).count() // ASIDE))
    kind = entries.schema["vector"].dataType.simpleString()
    deal_entries, deal_queries, dealt = _deal(made, spent, aside, kind)
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)))
    rows = salted.mapInPandas(deal_entries, dealt).unionByName(salted.where(asked).repartition("salt").mapInPandas(deal_queries, dealt))
    rows = rows.repartition("block", "aside").sortWithinPartitions("block", "aside", "is_query")
    return top(rows.mapInPandas(_meet(k), "query_id long, vec_id long, score double"), k)

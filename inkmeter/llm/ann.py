"""Approximate nearest neighbours by cosine: vantage-point trees per shard, relaxed pruning.

Vectors are scaled to length one, where cosine order is Euclidean order and the triangle inequality
holds. Pivots from a bounded sample part the space into cells, and the vectors of a cell, by their distance
to its centre, into rings of one shard each, so every shard is bounded whatever a hot cell holds. A query
searches the shard around it first, which gives its pruning radius, then every shard and subtree whose
lower bound, times ``relax``, does not exceed the radius: with ``relax`` 1 that is the plain triangle
inequality and the search is exact.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, load, stage
from .vectors import QUERY_EVERY, enough_of_each, found_rows, in_blocks, is_query, matrix, meet, once, ranked, routed, unpack, usable

#: Rows from which pivots are drawn, at most.
SAMPLE_ROWS = 4_096
SHARD_ROWS = 4_096
LEAF = 64
#: Lower bounds are multiplied by this before they are held against the radius.
RELAX = 2.0
#: Rounding of distances near zero.
SLACK = 1e-6


class VPTree:
    """Points reordered so that every subtree is a slice; inner nodes split at the median distance."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (start, end, vantage row, (inner lo, hi), (outer lo, hi), inner node, outer node)
        self.root = self._build(x, 0, len(x)) if len(x) else -1

    def _build(self, x: np.ndarray, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end, -1, None, None, -1, -1))
        if end - start > LEAF:
            own = self.order[start:end]
            vantage = own[0]
            d = np.linalg.norm(x[own] - x[vantage], axis=1)
            order = np.argsort(d, kind="stable")
            if d[order[-1]] > d[order[0]]:  # all points equal: stays a leaf
                self.order[start:end], d, mid = own[order], d[order], start + (end - start) // 2
                m = mid - start
                inner, outer = self._build(x, start, mid), self._build(x, mid, end)
                self.nodes[at] = (start, end, vantage, (d[0], d[m - 1]), (d[m], d[-1]), inner, outer)
        return at

    def search(self, x: np.ndarray, q: np.ndarray, skip: np.ndarray, ids: np.ndarray, radius: np.ndarray, k: int, relax: float):
        """Per query the k nearest row numbers found, by (distance, id), pruning from ``radius`` on."""
        n = len(q)
        near = np.full((n, k), np.inf)
        rows = np.full((n, k), -1, np.int64)
        radius = radius.copy()
        big = np.iinfo(np.int64).max

        def leaf(start: int, end: int, who: np.ndarray) -> None:
            for a in range(start, end, 1024):
                own = self.order[a : min(end, a + 1024)]
                d = np.round(1.0 - q[who] @ x[own].T, 13)  # equal vectors must tie whatever order their sums took
                d[ids[own][None, :] == skip[who][:, None]] = np.inf
                dist = np.concatenate([near[who], d], axis=1)
                row = np.concatenate([rows[who], np.broadcast_to(own, d.shape)], axis=1)
                tie = np.where(row >= 0, ids[row], big)
                tie[np.isinf(dist)] = big
                order = np.lexsort((tie, dist), axis=1)[:, :k]
                near[who], rows[who] = np.take_along_axis(dist, order, 1), np.take_along_axis(row, order, 1)
            radius[who] = np.minimum(radius[who], np.sqrt(np.maximum(0.0, 2 * near[who, k - 1])))

        def visit(node: int, who: np.ndarray) -> None:
            start, end, vantage, inner, outer, i, o = self.nodes[node]
            if vantage < 0:
                leaf(start, end, who)
                return
            d = np.linalg.norm(q[who] - x[vantage], axis=1)
            bound = {i: np.maximum(inner[0] - d, d - inner[1]), o: np.maximum(outer[0] - d, d - outer[1])}
            first = np.where(bound[i] <= bound[o], i, o)
            for turn in (0, 1):
                for child in (i, o):
                    own = (first == child) if turn == 0 else (first != child)
                    own &= relax * bound[child] <= radius[who] + SLACK
                    if own.any():
                        visit(child, who[own])

        if self.root >= 0 and n:
            visit(self.root, np.arange(n))
        rows[np.isinf(near)] = -1
        return rows


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine(q: np.ndarray, x: np.ndarray) -> float:
    """Of the original vectors, in double precision; both are scaled by powers of two against overflow."""
    q, x = (v * 2.0 ** -math.frexp(np.abs(v).max())[1] for v in (q, x))
    return float(np.dot(q, x) / (math.sqrt(np.dot(q, q)) * math.sqrt(np.dot(x, x))))


def pivots_of(rows: DataFrame, dims: int, n: int, count: int) -> np.ndarray:
    """Cell centres from a bounded sample by a few rounds of spherical k-means."""
    every = max(1, n // SAMPLE_ROWS)
    place = F.xxhash64("vec_id")
    sample = rows.filter(F.pmod(place, F.lit(every)) == 0).orderBy(place, "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    x = unit(np.array([r.v + [0.0] * (dims - len(r.v)) for r in sample]))
    centres = x[:: max(1, len(x) // count)][:count]
    for _ in range(5):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = unit(sums)
    return centres


def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(vec_id, v, cell, reach)``: the nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot = unit(matrix(batch.column(1), centres.shape[1])) @ centres.T
            cell = dot.argmax(axis=1)
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * dot[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(reach)], ["vec_id", "v", "cell", "reach"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, cell long, reach double")


class Shard:
    """A shard's vectors, original and of length one, and its tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tree: bytes):
        self.ids, self.x, self.unit, self.tree = ids, x, unit(x), pickle.loads(tree)

    def search(self, qids: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int, relax: float) -> list[tuple[list[int], list[float]]]:
        """The k nearest (ids, cosines) found for each query, pruning from its ``radius`` on."""
        found = self.tree.search(self.unit, unit(q), qids, self.ids, radius, k, relax)
        own = [[j for j in rows.tolist() if j >= 0] for rows in found]
        return [(self.ids[rows].tolist(), [cosine(q[at], self.x[j]) for j in rows]) for at, rows in enumerate(own)]


def _with_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            _, x = unpack(r["ids"], r["dims"], r["rows"], r["dims"])
            yield pa.RecordBatch.from_pylist([r | {"tree": pickle.dumps(VPTree(unit(x)))}], pa.schema([*batch.schema, ("tree", pa.binary())]))


def nearest(vectors: DataFrame, k: int = 5, relax: float = RELAX, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for every query, nearest first.

    Queries are the ids divisible by 50, candidates every other id. ``relax`` 1 searches exactly, larger
    values prune more. Vectors that are null, empty, zero, or hold a null or non-finite component take no
    part; shorter vectors count as padded with zeros; of rows repeating an id the smallest vector
    counts. Ties go to the smaller id. No usable vectors, no rows.

    A query first meets the one shard in whose ring it lies, which gives its radius, and then travels to those
    other shards alone that the radius admits.
    """
    if relax < 1:
        raise ValueError("relax must be at least 1")
    spark = vectors.sparkSession
    rows = stage(once(usable(vectors, id_col, vec_col).filter(F.exists("v", lambda x: x != 0))), "unit-vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = pivots_of(rows, dims, n, min(SAMPLE_ROWS // 4, math.ceil(n / shard_rows)))
    celled = stage(_assign(enough_of_each(rows, k), centres).withColumnRenamed("reach", "by"), "vector-cells")
    shards = stage(in_blocks(celled, shard_rows).mapInArrow(
        lean(_with_tree), "block long, cell long, lo double, hi double, ids binary, dims int, rows binary, tree binary"), "vantage-trees")
    # one row a shard: its cell, and the ring around the cell's centre that it fills
    index = shards.select("block", "cell", "lo", "hi").orderBy("block").collect()
    block, cell, lo, hi = (np.array([r[c] for r in index]) for c in range(4))
    centre_of, near = centres[cell], np.unique(cell)

    def gaps(q: np.ndarray) -> np.ndarray:
        """Per query and shard a lower bound of the distance to anything in the shard."""
        d = np.zeros((len(q), len(centres)))
        d[:, near] = np.sqrt(np.maximum(0.0, 2 - 2 * unit(q) @ centres[near].T))
        d = d[:, cell]
        return np.maximum(0.0, np.maximum(lo - d, d - hi))

    def home_of(ids: np.ndarray, q: np.ndarray, _) -> Iterator[np.ndarray]:
        for at, gap in enumerate(gaps(q)):
            d = np.linalg.norm(unit(q[at : at + 1]) - centre_of, axis=1)
            own = np.where(gap <= gap.min() + SLACK, d, np.inf)
            ties = np.flatnonzero(own <= own.min() + SLACK)
            yield block[ties[ids[at] // QUERY_EVERY % len(ties)]][None]

    def admit(ids: np.ndarray, q: np.ndarray, radius: np.ndarray) -> Iterator[np.ndarray]:
        homes = home_of(ids, q, radius)
        for gap, own, r in zip(gaps(q), homes, radius, strict=True):
            yield block[(relax * gap <= r + SLACK) & (block != own[0])]

    def met(queries: DataFrame, to, keep: bool) -> DataFrame:
        return meet(
            shards, routed(queries, dims, to), dims, lambda ids, size, data, tree: Shard(*unpack(ids, size, data, dims), tree),
            lambda shard, ids, q, radius: shard.search(ids, q, radius, k, relax), "double", keep)

    queries = rows.filter(is_query()).select("vec_id", "v", F.lit(float("inf")).alias("bound"))
    home = stage(met(queries, home_of, True), "home-neighbours")
    kth = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.array_min("score")))
    known = home.select("vec_id", "v", F.when(F.size("found") >= k, kth).otherwise(float("inf")).alias("bound"))
    return ranked(found_rows(home.select("vec_id", "found", "score")).unionByName(found_rows(met(known, admit, False))), k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))


QUERIES = {"op3_ann": op3_ann}
ORACLE_SQL: dict[str, str] = {}

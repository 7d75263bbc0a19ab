"""Exact top-k inner products: norm-sorted blocks with SVD-rotated partial sums.

Vectors are cut into bounded blocks by descending length. The queries first meet the block of the
longest vectors, which gives each a threshold. A query then travels only to the blocks whose largest
length times the query's reaches its threshold. There the leading coordinates in the basis of the corpus'
singular vectors are summed, and a vector is dropped once its partial sum plus the Cauchy-Schwarz bound
on the rest falls below the threshold. What is left is scored in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, load, stage
from .vectors import best, enough_of_each, found_rows, in_blocks, is_query, matrix, meet, once, ranked, routed, unpack, usable

SCALE = 256
#: Components whose 256-fold reaches this raise: their squares would leave a double.
WIDEST = 2.0**500
BLOCK_ROWS = 4_096
LONG = 1 << 63


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, length)`` with components floor(256·x) as doubles, which hold each of them exactly."""
    # from 2^53 on a double is a whole number itself
    scaled = F.transform("v", lambda x: F.when(F.abs(x) * SCALE < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    rows = once(usable(vectors, id_col, vec_col)).select("vec_id", scaled.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    too_wide = F.raise_error(F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" has a component of 2^500 / 256 or more"))).cast("double")
    return rows.withColumn("length", F.when(F.exists("v", lambda x: F.abs(x) >= WIDEST), too_wide).otherwise(length))


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the whole table, from its summed Gram matrix (dims² numbers reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dims, dims))
        for batch in batches:
            m = matrix(batch.column(0), dims)
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(gram.ravel())], ["at", "x"])

    gram = np.zeros(dims * dims)
    for at, x in rows.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
        gram[at] = x
    gram /= max(1.0, np.abs(gram).max())
    return np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1].copy()


class Block:
    """A block's vectors, rotated, with the lengths of what partial sums leave out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray):
        self.ids, self.x, self.basis, dims = ids, x, basis, x.shape[1]
        self.lengths = np.linalg.norm(x, axis=1)
        self.longest = self.lengths.max(initial=0.0)
        self.rotated = x @ basis
        self.cuts = sorted({max(1, dims // 4), max(1, dims // 2)})
        self.rest = {h: np.linalg.norm(self.rotated[:, h:], axis=1) for h in self.cuts}

    def scores(self, own: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products with rows ``own``: as doubles or longs while no sum can outgrow them, else as whole numbers of any size."""
        x, bound = self.x[own], self.longest * np.linalg.norm(q) * (1 + 1e-9)
        if bound < 2.0**52:
            return (x @ q).astype(np.int64)
        if bound < 2.0**62:
            return x.astype(np.int64) @ q.astype(np.int64)
        whole = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x.tolist()], object)

    def search(self, qid: int, q: np.ndarray, floor: float, k: int) -> tuple[list[int], list[int]]:
        """The up to k best (ids, scores) that reach ``floor``."""
        length = np.linalg.norm(q)
        slack = 1e-9 * (1 + self.longest * length)  # rounding of the rotated sums
        if self.longest * length + slack < floor:
            return [], []
        rotated = q @ self.basis
        own, partial, done = np.arange(len(self.ids)), np.zeros(len(self.ids)), 0
        for h in self.cuts:
            partial = partial + self.rotated[own, done:h] @ rotated[done:h]
            keep = partial + self.rest[h][own] * np.linalg.norm(rotated[h:]) + slack >= floor
            own, partial, done = own[keep], partial[keep], h
        own = own[self.ids[own] != qid]
        score = self.scores(own, q)
        if score.dtype == object:
            top = sorted(range(len(own)), key=lambda j: (-score[j], self.ids[own[j]]))[:k]
            if any(not -LONG <= score[j] < LONG for j in top):
                raise OverflowError(f"a score of query {qid} does not fit in a long")
        else:
            top = best(score, self.ids[own], k)
        return [int(self.ids[own[j]]) for j in top], [int(score[j]) for j in top]


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of every query, exactly.

    Queries are the ids divisible by 50. Vectors that are null, empty or hold a null or non-finite
    component take no part; shorter vectors count as padded with zeros; of rows repeating an id the
    smallest vector counts. Ties go to the smaller id. No usable vectors, no rows. Scores are exact whatever
    the size of the components; one among the k best of a block that does not fit in a long raises, and so
    does a component of 2^500 / 256 or more.
    """
    spark = vectors.sparkSession
    rows = stage(integers(vectors, id_col, vec_col), "integer-vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(rows, dims)
    few = stage(enough_of_each(rows, k), "distinct-vectors")
    blocks = stage(in_blocks(few.select(F.lit(0).cast("long").alias("cell"), (-F.col("length")).alias("by"), "vec_id", "v"), block_rows), "vector-blocks")
    # one row a block; "by" is the negative length, so the first one is the longest
    index = blocks.select("block", (-F.col("lo")).alias("longest")).orderBy(F.desc("longest"), "block").collect()
    numbers, longest = np.array([r.block for r in index]), np.array([r.longest for r in index])
    head = spark.sparkContext.broadcast(blocks.filter(F.col("block") == int(numbers[0])).select("ids", "dims", "rows").first())  # at most block_rows vectors

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*unpack(*head.value, dims), basis)
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            hits = [block.search(int(i), own, float("-inf"), k) for i, own in zip(ids, q, strict=True)]
            floor = [float(h[1][-1]) if len(h[1]) == k else float("-inf") for h in hits]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(floor, pa.float64()), pa.array([h[0] for h in hits], pa.list_(pa.int64())),
                pa.array([h[1] for h in hits], pa.list_(pa.int64()))], ["vec_id", "v", "bound", "found", "score"])

    queries = rows.filter(is_query()).select("vec_id", "v")
    known = stage(queries.mapInArrow(lean(first), "vec_id long, v array<double>, bound double, found array<long>, score array<long>"), "head-scores")

    def admit(ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> Iterator[np.ndarray]:
        for length, least in zip(np.linalg.norm(q, axis=1), floor, strict=True):
            reach = longest * length
            yield numbers[1 : max(1, int(np.count_nonzero(reach + 1e-9 * (1 + reach) >= least)))]

    others = meet(
        blocks, routed(known, dims, admit), dims, lambda ids, size, data, _: Block(*unpack(ids, size, data, dims), basis),
        lambda block, ids, q, floor: [block.search(int(i), own, f, k) for i, own, f in zip(ids, q, floor, strict=True)], "long")
    return ranked(found_rows(known.select("vec_id", "found", "score")).unionByName(found_rows(others)), k)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


QUERIES = {"op10_topk": op10_topk}
ORACLE_SQL = {
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.e::DOUBLE[], x.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}

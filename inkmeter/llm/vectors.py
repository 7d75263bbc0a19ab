"""Vector tables as blocks: cleaning, the query set, streaming blocks, routed searches and final ranking, shared by both searches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

QUERY_EVERY = 50
#: Queries of a block beyond which the block is searched by several tasks.
PART_QUERIES = 16_384
#: Partitions of a routed search, at most; beyond it a task holds several blocks, one after the other.
MOST_PARTITIONS = 65_536


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows with an id whose vector is present, not empty, and finite throughout."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def is_query() -> Column:
    return F.col("vec_id") % QUERY_EVERY == 0


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int, largest: bool = True) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    key = -score if largest else score
    if len(key) > 4 * k:
        bound = np.partition(key, k - 1)[k - 1]
        few = np.flatnonzero(key <= bound)
    else:
        few = np.arange(len(key))
    return few[np.lexsort((ids[few], key[few]))][:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of ``(query_id, vec_id, score)`` per query; each block contributed k rows at most."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def once(vectors: DataFrame) -> DataFrame:
    """One row per id; of rows that repeat an id the smallest vector counts."""
    return vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def enough_of_each(rows: DataFrame, k: int) -> DataFrame:
    """Of every distinct vector the rows with the k + 1 smallest ids.

    No query can have another row of that vector among its k best: all of them score the same, and k of the
    kept ones are not the query itself and have smaller ids. So a vector that a third of all rows share is
    a few rows for the index, and no result changes. The limit is applied before the shuffle as well.
    """
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(block, cell, lo, hi, ids, dims, rows)`` from ``(cell, by, vec_id, v)``: runs of up to ``size`` rows of one cell in the order of ``by``.

    Rows are range-partitioned, so neither a hot cell nor equal ``by`` meet in one task, and cut as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal block, held, n
            table = pa.Table.from_batches(held).combine_chunks()
            cell, by, ids, v = (table.column(k).chunk(0) for k in range(4))
            dims = int(v.value_lengths().to_numpy(zero_copy_only=False).max())
            found = pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), cell[:1], pa.array([min(by[0].as_py(), by[n - 1].as_py())]), pa.array([max(by[0].as_py(), by[n - 1].as_py())]),
                pa.array([ids.to_numpy().tobytes()]), pa.array([dims], pa.int32()), pa.array([matrix(v, dims).tobytes()])],
                ["block", "cell", "lo", "hi", "ids", "dims", "rows"])
            block, held, n = block + 1, [], 0
            return found

        for batch in batches:
            cell = batch.column(0).to_numpy()
            ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)] if len(cell) else []
            start = 0
            for end in map(int, ends):
                if held and held[-1].column(0)[0].as_py() != cell[start]:
                    yield out()
                while start < end:
                    take = min(end - start, size - n)
                    held.append(batch.slice(start, take))
                    start, n = start + take, n + take
                    if n == size:
                        yield out()
        if held:
            yield out()

    parts = max(1, math.ceil(rows.count() / (4 * size)))
    dealt = rows.select("cell", "by", "vec_id", "v").repartitionByRange(parts, "cell", "by", "vec_id").sortWithinPartitions("cell", "by", "vec_id")
    return dealt.mapInArrow(lean(run), "block long, cell long, lo double, hi double, ids binary, dims int, rows binary")


def unpack(ids: bytes, dims: int, rows: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix, padded with zero columns up to ``width``."""
    own = np.frombuffer(ids, np.int64)
    m = np.frombuffer(rows, np.float64).reshape(len(own), dims)
    return own, m if dims == width else np.pad(m, ((0, 0), (0, width - dims)))


def routed(queries: DataFrame, dims: int, admit: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """``(vec_id, v, bound, block)``: every query of ``(vec_id, v, bound)`` once for each block that ``admit`` names for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bound = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            to = list(admit(ids, matrix(batch.column(1), dims), bound))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, to)]), pa.int32()), pa.array(np.concatenate(to) if to else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["vec_id", "v", "bound", "to"])

    sent = queries.select("vec_id", "v", "bound").mapInArrow(lean(run), "vec_id long, v array<double>, bound double, to array<long>")
    return sent.select("vec_id", "v", "bound", F.explode("to").alias("block"))


_MET = "vec_id long, v array<double>, found array<long>, score array<{}>"


def meet(blocks: DataFrame, sent: DataFrame, dims: int, open_block: Callable, search: Callable, score: str, keep: bool = False) -> DataFrame:
    """``(vec_id, v, found, score)``: what ``search(open_block(row), ids, vectors, bounds)`` finds for each query in each block it is routed to.

    A block travels once, ahead of its queries, which stream by in batches: blocks and routed queries are dealt by
    block and sorted so that the block comes first. A block that very many queries reach is dealt to several
    tasks. ``keep`` returns the queries' vectors as well.
    """
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            is_block = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            at = 0
            for stop in [*np.flatnonzero(is_block).tolist(), batch.num_rows]:
                if stop > at:
                    own = batch.slice(at, stop - at)
                    ids, bound = own.column(4).to_numpy(), own.column(6).to_numpy()
                    hits = search(opened, ids, matrix(own.column(5), dims), bound)
                    vectors = own.column(5) if keep else pa.nulls(len(ids), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([
                        own.column(4), vectors, pa.array([h[0] for h in hits], pa.list_(pa.int64())), pa.array([h[1] for h in hits], pa.list_(kind))],
                        ["vec_id", "v", "found", "score"])
                if stop < batch.num_rows:
                    opened = open_block(*(batch.column(k)[stop].as_py() for k in (1, 2, 3, 7)))
                at = stop + 1

    extra = F.col("tree") if "tree" in blocks.columns else F.lit(None).cast("binary")
    parts = sent.groupBy("block").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("parts"))  # one row a block
    none = lambda t: F.lit(None).cast(t)
    left = blocks.join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "dims", "rows", none("long").alias("vec_id"), none("array<double>").alias("v"),
        none("double").alias("bound"), extra.alias("tree"))
    right = sent.join(parts, "block").select(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), none("binary").alias("ids"), none("int").alias("dims"), none("binary").alias("rows"),
        "vec_id", "v", "bound", none("binary").alias("tree"))
    n = max(1, min(MOST_PARTITIONS, blocks.count()))
    dealt = left.unionByName(right).repartition(n, "block", "part").sortWithinPartitions("block", "part", F.col("vec_id").asc_nulls_first())
    picked = dealt.select("block", "ids", "dims", "rows", "vec_id", "v", "bound", "tree")
    return picked.mapInArrow(lean(run), _MET.format(score))


def found_rows(met: DataFrame) -> DataFrame:
    """``(query_id, vec_id, score)`` of ``meet``'s results."""
    return met.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("found", "score")).alias("f")).select(
        "query_id", F.col("f.found").alias("vec_id"), F.col("f.score").alias("score"))

"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at up to 3 differing bits, so in one of their two halves they differ in at
most one bit. On 31 bits of a half the codewords of the perfect Hamming [31,26] code are the anchors:
covering radius 1, so each fingerprint has exactly one home anchor within distance 1, and every
fingerprint that differs from it in at most one of those bits lies within distance 2 of that anchor. Each
distinct fingerprint is sent to every anchor within 2 (at most 16 a half) and compared there with the
fingerprints at home. Each task passes on a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lean, load, small_batches, stage, text_or_empty, whole_row
from .graph import components, forest

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: Groups at an anchor up to this size are compared directly, larger ones through equal 16-bit blocks.
DIRECT = 64
_ROWS = 1 << 18
_LANES = np.uint64(0x0001000100010001)
_SHIFTS = np.arange(16, dtype=np.uint64)[:, None]


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set where more than half of the hashes have them set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_535):
        sums = ((hashes[None, at : at + 65_535] >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64)
        for lane in range(4):
            ones[16 * lane : 16 * lane + 16] += ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 bytes: A-Z lowered, words parted by ASCII white space, word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(t), SEED) for t in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)
    return bit_majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("t"))
    return picked.mapInArrow(lean(run), "doc_id long, fp long")


def _anchored(fps: DataFrame) -> DataFrame:
    """``(anchor, fp, home)``: every distinct fingerprint at each anchor within distance 2, in both halves."""
    masks = [[0]] + [[1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s] for s in range(1, 32)]
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
    parts = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0x7FFFFFFF))
        syndrome = sum(
            (F.bit_count(bits.bitwiseAND(F.lit(sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)))) % 2) * (1 << b) for b in range(5))
        near = fps.select("fp", bits.alias("bits"), F.posexplode(F.get(table, syndrome)).alias("nth", "mask"))
        parts.append(near.select(
            F.col("bits").bitwiseXOR(F.col("mask")).bitwiseOR(F.lit(half << 31)).alias("anchor"), "fp", (F.col("nth") == 0).alias("home")))
    return parts[0].unionByName(parts[1])


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal ``key`` (sorted, groups up to ``limit``) of which one is at home."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    left = np.repeat(start + size, size) - np.arange(len(key))  # rows from here to the end of the group
    at = np.flatnonzero((left > 1) & (np.repeat(size, size) <= (limit or len(key))))
    a, b, held, k = [], [], 0, 1
    while len(at):
        x, y = fp[at], fp[at + k]
        hit = (np.bitwise_count(x ^ y) <= most) & (home[at] | home[at + k])
        a.append(x[hit])
        b.append(y[hit])
        held += len(a[-1])
        if held > 1 << 20:
            r, m = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [r], [m], 0
        k += 1
        at = at[left[at] > k]
    return forest(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _link(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    links = [_compare(key, fp, home, most, DIRECT)]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    for at, n in zip(start[size > DIRECT], size[size > DIRECT], strict=True):
        own, at_home = fp[at : at + n], home[at : at + n]
        if not at_home.any():
            continue
        for block in range(4):  # up to 3 bits differ, so one of 4 blocks is equal
            value = (own >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            order = np.argsort(value, kind="stable")
            links.append(_compare(value[order], own[order], at_home[order], most, None))
    return forest(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``(a, b)`` links that connect what pairs of distinct fingerprints within ``most`` (up to 3) bits connect."""
    if not 0 <= most <= 3:
        raise ValueError("the covering is built for up to 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held, full = 0, _ROWS

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = _link(*rows, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            anchor = batch.column(0).to_numpy(zero_copy_only=False)
            kept.append((anchor, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            held += len(anchor)
            if held >= full:
                rows = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
                kept, held = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
                full = max(_ROWS, 2 * held)  # a large anchor is copied a few times, not once a batch
                if cut:
                    yield out(tuple(x[:cut] for x in rows))
        if held:
            yield out(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))

    dealt = _anchored(fps).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    Fingerprints within ``most`` bits link, transitively; ``component_id`` is the smallest id reachable.
    Null and wordless texts share fingerprint 0 and link like any others. Equal fingerprints are one
    node, so a group of copies of any size costs one row per fingerprint. Repeated rows stay; null ids
    count only if a component has no other. Extra columns are ignored.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = stage(components(links(groups, most)), "fingerprint-roots")
    linked = groups.join(broadcast_if_small(roots), groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(lowest, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """The row with the smallest id of every near-duplicate group; all columns stay. Rows without id are kept.

    Near-duplicates are texts at five-word similarity 0.8 or more, or with fingerprints within ``most`` bits. Rows
    that share an id are judged by their texts; of several rows of a group that have its smallest id one stays.
    """
    from .nearcopies import near_copies

    found = near_copies(docs, id_col, text_col, most=most)
    heads = found.filter("doc_id = component_id")
    several = heads.groupBy("label").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = stage(heads.join(several, "label").select("doc_id", "own", (F.col("own") == F.col("first")).alias("stays")).distinct(), "repeated-ids")
    gone = found.filter("doc_id <> component_id").select("doc_id", "own").unionByName(several.filter("NOT stays").select("doc_id", "own"))
    gone = broadcast_if_small(stage(gone.distinct(), "duplicate-ids"))
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("own"))
    rest = rows.join(gone, ["doc_id", "own"], "left_anti")
    again = several.filter("stays").select("doc_id", "own")
    if not again.isEmpty():
        again = broadcast_if_small(again, several)
        rest = rest.join(again, ["doc_id", "own"], "left_anti").unionByName(rest.join(again, ["doc_id", "own"], "left_semi").dropDuplicates(["doc_id", "own"]))
    return rest.select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}

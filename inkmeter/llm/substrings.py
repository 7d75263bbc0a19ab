"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first 100 bytes of a suffix matter: two positions hold a repeated window exactly if their
suffixes agree to that depth. Suffixes are taken at anchors alone, the least 32-byte gram of each window
(equal windows have it at the same place), which cuts the suffixes to about a thirtieth. Passes refine the
groups digit by digit and drop what is single:

1. the gram at the anchor and the whole reach of the windows around it (68 bytes to either side): what
   agrees in both and is not the first is a repeat, all of it;
2. where a gram has several surroundings, the 34 bytes next to it on one side: every window that holds
   the gram holds one of the two sides whole;
3. the rest of each of the up to 35 windows on that side.

Equal groups at depth 100 are the repeated windows; all of a group but its first position are removed.
Digits are compared by 64-bit hashes, and wherever a decision falls two independent ones must agree: 128 bits.

Texts are dealt by document once, into a bucketed table; positions go to them, never texts to positions. No
group has to fit a task: grams that a sample finds in a hundredth of the texts are dealt by their surroundings
too, their windows by document, and what a group that is held in parts has first in each part goes
through one more pass, in which a window's places stream by.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lean, load, scratch_path, small_batches, stage, text_or_empty

DEPTH = 100
GRAM = 32
SIDE = DEPTH - GRAM
HALF = SIDE // 2
#: Anchors and surroundings that a task holds at once.
ANCHOR_ROWS = 1 << 18
REFINE_ROWS = 1 << 16
#: Texts that are looked through for hot grams, and the share of them that makes a gram hot.
SAMPLE_ROWS = 2_000
HOT_SHARE = 0.01
#: Bytes of stored texts in a bucket, about.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 100_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POS_BITS = 20
_POS = np.uint64((1 << _POS_BITS) - 1)
_ANCHORS = "deal long, gram long, around long, doc long, at long, len long"
_SEGMENT = (1 << _POS_BITS) - 4 * DEPTH
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x ^= x >> _U(29)
    x *= _MIX
    return x ^ (x >> _U(32))


def rolling(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte and all 64-byte substrings."""
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    h += _U(1)
    for size in (1, 2, 4, 8, 16):
        h = h[:-size] * _power(size) + h[size:]
    return h, h[:-32] * _power(32) + h[32:]


def anchors_of(gram: np.ndarray) -> np.ndarray:
    """Positions that are the leftmost least mixed gram of some run of SIDE + 1 positions, ascending."""
    found = []
    for a in range(0, len(gram) - SIDE, _SEGMENT):
        key = mixed(gram[a : a + _SEGMENT + SIDE])
        key = (key & ~_POS) | np.arange(len(key), dtype=np.uint64)
        low, size = key, 1
        while 2 * size <= SIDE + 1:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(key) - SIDE], low[SIDE + 1 - size :]) & _POS
        found.append(low[np.flatnonzero(np.r_[True, low[1:] != low[:-1]])].astype(np.int64) + a)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that are sorted by document and start and whose ends ascend with their starts."""
    if not len(doc):
        return doc, lo, hi
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], lo[first], hi[last]


def _is_hot(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether signed ``gram`` is in the sorted list ``hot``."""
    if not len(hot):
        return np.zeros(len(gram), bool)
    return hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram


def _anchor_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(deal, gram, around, doc, at, len)``: anchors (len 0, at = 128·position + bytes to the right) of which a
    (gram, around) pair leaves the task once a chunk, and the intervals that this settles."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        gram, around, doc, pos, right = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, around, gram))
        gram, around, doc, pos, right = (x[order] for x in (gram, around, doc, pos, right))
        first = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]
        rep = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = np.flatnonzero(~first & ((doc != doc[rep]) | (pos != pos[rep])))
        again = again[np.lexsort((pos[again], doc[again]))]
        d, lo, hi = merged(doc[again], pos[again] - np.minimum(SIDE, pos[again]), pos[again] + GRAM + right[again])
        own, side = gram[first].view(np.int64), around[first].view(np.int64)
        deal = np.where(_is_hot(own, hot), mixed(own.view(np.uint64) ^ mixed(side.view(np.uint64))).view(np.int64), own)
        far = mixed(d.astype(np.uint64)).view(np.int64)
        cols = (
            np.r_[deal, far], np.r_[gram[first].view(np.int64), far], np.r_[around[first].view(np.int64), np.zeros(len(d), np.int64)],
            np.r_[doc[first], d], np.r_[pos[first] * 128 + right[first], lo], np.r_[np.zeros(first.sum(), np.int64), hi - lo])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["deal", "gram", "around", "doc", "at", "len"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes()
            if len(data) < DEPTH:
                continue
            gram, wide = rolling(data)
            pos = anchors_of(gram)
            right = np.minimum(len(data) - GRAM - pos, SIDE)
            lo, hi = pos - np.minimum(SIDE, pos), pos + GRAM + right
            # three overlapping 64-byte pieces cover up to 168 bytes, with their lengths
            around = mixed(wide[lo]) + mixed(wide[np.minimum(lo + 52, hi - 64)]) * _U(3) + mixed(wide[hi - 64]) * _U(5)
            around = mixed(around + (pos - lo).astype(np.uint64) * _U(1_000_003) + right.astype(np.uint64))
            held.append((gram[pos], around, np.full(len(pos), doc, np.int64), pos, right))
            n += len(pos)
            if n >= ANCHOR_ROWS:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _settle(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by (gram, around, doc, at): ``(doc, kind, a, b)``, kind 0 a settled interval
    [a, b), kind 1 an anchor to refine (a = at, b = 1 if its gram is hot). Holds one row between batches."""
    last = None  # first row of the run that is open, and whether it has been asked for
    for batch in batches:
        gram, around, doc, at, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        through = size > 0
        out = [(doc[through], np.zeros(through.sum(), np.int32), at[through], at[through] + size[through])]
        gram, around, doc, at = (x[~through] for x in (gram, around, doc, at))
        if len(gram):
            asked = False
            if last is not None:
                gram, around, doc, at = (np.r_[x, y] for x, y in zip(last[:4], (gram, around, doc, at), strict=True))
                asked = last[4]
            first = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]
            rep = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            again = ~first & ((doc != doc[rep]) | (at != at[rep]))
            pos, right = at[again] >> 7, at[again] & 127
            out.append((doc[again], np.zeros(len(pos), np.int32), pos - np.minimum(SIDE, pos), pos + GRAM + right))
            reps = np.flatnonzero(first)
            g = gram[reps]
            warm = _is_hot(g, hot)  # their other surroundings may lie in other tasks
            several = warm | np.r_[False, g[1:] == g[:-1]] | np.r_[g[1:] == g[:-1], False]
            ask = reps[several]
            if asked and len(ask) and ask[0] == 0:
                ask = ask[1:]
            out.append((doc[ask], np.ones(len(ask), np.int32), at[ask], _is_hot(gram[ask], hot).astype(np.int64)))
            i = reps[-1]
            last = (gram[i], around[i], doc[i], at[i], bool(several[-1]) or (i == 0 and asked))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc", "kind", "a", "b"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, deal, doc, meta, bytes)``: for either side of an anchor, the 34 bytes next to the gram as the key's
    digit and the further bytes that its windows take from both ends. Keys of hot grams (odd ``asked``) are dealt by
    document as well."""
    for batch in batches:
        keys, deals, docs, metas, rest = [], [], [], [], []
        for doc, asked, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes()
            asked_at = asked.values.to_numpy()
            at, hot = asked_at >> 1, asked_at & 1
            for p, right, warm in zip((at >> 7).tolist(), (at & 127).tolist(), hot.tolist(), strict=True):
                gram = data[p : p + GRAM]
                left = min(SIDE, p)
                before, after = data[p - left : p][::-1], data[p + GRAM : p + GRAM + right]
                for side, near, u, v, low, high in (
                    (0, after[:HALF], before[:HALF], after[HALF:], max(0, SIDE - right), min(HALF - 1, left)),
                    (1, before[:HALF], before[HALF:], after[:HALF], max(HALF, SIDE - right) - HALF, min(SIDE, left) - HALF),
                ):
                    if low <= high and len(near) == HALF:
                        keys.append(hashlib.blake2b(near + bytes([side]) + gram, digest_size=8).digest())
                        deals.append(doc if warm else None)
                        docs.append(doc)
                        metas.append((((p * 2 + side) * 64) + low) * 64 + high)
                        rest.append(u.ljust(HALF, b"\0") + v.ljust(HALF, b"\0"))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(deals, pa.int64()), pa.array(docs, pa.int64()), pa.array(metas, pa.int64()), pa.array(rest, pa.binary())], ["key", "deal", "doc", "meta", "rest"])


def _refine(key: np.ndarray, part: np.ndarray, doc: np.ndarray, meta: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, kind, start, end, key, hash) of what repeats within groups of equal key; rows sorted by (key, doc, meta).

    Kind 0 is an interval to remove. Rows with ``part`` set belong to a group that is held in parts: for them
    kind 1 is the first place here of each window (hash), which may have an earlier one elsewhere.
    """
    new = np.r_[True, key[1:] != key[:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(key)])
    some = np.repeat(size > 1, size) | part
    key, part, doc, meta, rest = key[some], part[some], doc[some], meta[some], rest[some]
    pos, side, low, high = meta >> 13, (meta >> 12) & 1, (meta >> 6) & 63, meta & 63
    salt, n = mixed(key.view(np.uint64)), len(key)
    front = np.zeros((HALF + 1, n), np.uint64)
    back = np.zeros((HALF + 1, n), np.uint64)
    for i in range(HALF):
        front[i + 1] = front[i] * _power(1) + rest[:, i] + _U(1)
        back[i + 1] = back[i] * _power(3) + rest[:, HALF + i] + _U(1)
    least, most = np.full(n, 99), np.full(n, -1)
    firsts = []
    for u in range(HALF + 1):
        own = np.flatnonzero((low <= u) & (u <= high))
        if not len(own):
            continue
        h = mixed(salt[own] + mixed(front[u, own]) * _U(7) + mixed(back[HALF - u, own] + _U(11)) + _U(u))
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        first = np.r_[True, h[1:] != h[:-1]]
        rep = own[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        again = own[~first & ((doc[own] != doc[rep]) | (pos[own] != pos[rep]))]
        least[again] = np.minimum(least[again], u)
        most[again] = u
        open_ = first & part[own]
        at = own[open_]
        firsts.append((doc[at], pos[at] - side[at] * HALF - u, key[at], h[open_].view(np.int64)))
    hit = np.flatnonzero(most >= 0)
    offset = side[hit] * HALF
    f_doc, f_at, f_key, f_hash = (np.concatenate(x) for x in zip(*firsts, strict=True)) if firsts else (key[:0],) * 4
    none = np.zeros(len(hit), np.int64)
    return (
        np.r_[doc[hit], f_doc], np.r_[np.zeros(len(hit), np.int32), np.ones(len(f_doc), np.int32)], np.r_[pos[hit] - offset - most[hit], f_at],
        np.r_[pos[hit] - offset - least[hit] + DEPTH, f_at + DEPTH], np.r_[none, f_key], np.r_[none, f_hash])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_refine`` over rows (key, hot, doc, meta, rest) sorted by (key, doc, meta). At most about REFINE_ROWS rows are held:
    a group that fills them is treated in parts, like those of hot grams."""
    held: list[tuple[np.ndarray, ...]] = []
    n, parted = 0, None

    def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, part, *more = rows
        found = _refine(key, part | (key == parted) if parted is not None else part, *more)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["doc", "kind", "a", "b", "key", "hash"])

    for batch in batches:
        rest = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SIDE)
        held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), rest))
        n += batch.num_rows
        if n >= REFINE_ROWS:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if rows[0][-1] == parted or not cut:
                cut, parted = n, int(rows[0][-1])
            held, n = [tuple(x[cut:] for x in rows)], n - cut
            yield out(tuple(x[:cut] for x in rows))
    if n:
        yield out(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows (key, hash, doc, a, b) sorted by all of them: ``(doc, a, b)`` of all places but the first. Holds one row."""
    first_row = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        if first_row is not None:
            rows = [np.r_[x, y] for x, y in zip(first_row, rows, strict=True)]
        key, h, doc, a, b = rows
        first = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
        rep = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = ~first & ((doc != doc[rep]) | (a != a[rep]))
        first_row = [x[rep[-1]] for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c[again]) for c in (doc, a, b)], ["doc", "a", "b"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, cuts, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes()
            spans, kept, at = 0, hashlib.sha256(), 0
            removed = 0
            end = -1
            if cuts.is_valid:
                found = cuts.values.to_numpy()
                lo, hi = found[: len(found) // 2], found[len(found) // 2 :]
                for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
                    if a > end:
                        kept.update(data[at:a])
                        spans, end = spans + 1, a
                    if b > end:
                        removed, end, at = removed + b - end, b, b
            kept.update(data[at:])
            rows.append((doc, len(data), removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, data)`` of the rows with an id, as a table bucketed by document: later joins move what they bring, not the texts."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc"), F.encode(text_or_empty(text_col), "UTF-8").alias("data")).filter("doc IS NOT NULL")
    total = picked.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES)))
    name, path = f"inkmeter_texts_{uuid.uuid4().hex[:12]}", scratch_path(spark, "texts")
    picked.repartition(n, "doc").write.bucketBy(n, "doc").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def hot_grams(texts: DataFrame) -> np.ndarray:
    """Grams of anchors in a hundredth of a sample's texts or more, ascending: they set how work is dealt, never what it finds.

    At most a hundred times the anchors of an average text.
    """
    rows = texts.count()
    every = max(1, rows // SAMPLE_ROWS)
    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).mapInArrow(lean(lambda x: _anchor_rows(x, np.zeros(0, np.int64))), _ANCHORS).filter("len = 0")
    least = max(20, int(HOT_SHARE * rows / every))
    return np.sort(np.array([r.gram for r in some.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()], np.int64))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(doc, cuts)`` of a table of ``_by_document``: the starts and then the ends of the byte intervals to remove (they may overlap)."""
    small_batches(texts.sparkSession)
    # whole copies are settled first: all but the smallest id go, and take no part in what follows
    digests = stage(texts.select("doc", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n")).filter(F.col("n") >= DEPTH), "text-digests")
    firsts = stage(digests.groupBy("sha").agg(F.min("doc").alias("least"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "least"), "copied-digests")
    copies = stage(digests.join(broadcast_if_small(firsts), "sha").filter("doc > least").select("doc", "n"), "whole-copies")
    rest = texts.join(copies.select("doc").hint("shuffle_hash"), "doc", "left_anti")
    hot = hot_grams(texts)
    anchors = rest.mapInArrow(lean(lambda x: _anchor_rows(x, hot)), _ANCHORS)
    dealt = anchors.repartition("deal").drop("deal").sortWithinPartitions("gram", "around", "doc", "at")
    settled = stage(dealt.mapInArrow(lean(lambda x: _settle(x, hot)), "doc long, kind int, a long, b long"), "settled-anchors")
    asked = settled.filter("kind = 1").groupBy("doc").agg(F.collect_list(F.col("a") * 2 + F.col("b")).alias("asked"))
    around = rest.join(asked.hint("shuffle_hash"), "doc").select("doc", "asked", "data").mapInArrow(lean(_surroundings), "key long, deal long, doc long, meta long, rest binary")
    around = around.repartition("key", "deal").select("key", F.col("deal").isNotNull().alias("hot"), "doc", "meta", "rest").sortWithinPartitions("key", "doc", "meta")
    refined = stage(around.mapInArrow(lean(_refined), "doc long, kind int, a long, b long, key long, hash long"), "refined-windows")
    parted = refined.filter("kind = 1").select("key", "hash", "doc", "a", "b").repartition("key", "hash").sortWithinPartitions("key", "hash", "doc", "a")
    again = parted.mapInArrow(lean(_again), "doc long, a long, b long")
    spans = settled.filter("kind = 0").select("doc", "a", "b").unionByName(refined.filter("kind = 0").select("doc", "a", "b")).unionByName(again).unionByName(
        copies.select("doc", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    # starts, then ends, as one array of numbers; both lists are gathered in one order
    return stage(spans.groupBy("doc").agg(F.concat(F.collect_list("a"), F.collect_list("b")).alias("cuts")), "byte-cuts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every document once each repeated 100-byte string is gone but its first place.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row. Null text is
    empty. Texts under 100 bytes never change. Rows that share an id are one document. Rows without id
    stay whole and take no part. Extra columns are ignored.
    """
    texts = _by_document(docs, id_col, text_col)
    joined = texts.join(repeated_spans(texts).hint("shuffle_hash"), "doc", "left").select("doc", "cuts", "data")
    bare = docs.select(F.col(id_col).cast("long").alias("doc"), F.lit(None).cast("array<long>").alias("cuts"), F.encode(text_or_empty(text_col), "UTF-8").alias("data")).filter("doc IS NULL")
    return joined.unionByName(bare).mapInArrow(lean(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


QUERIES = {"op6_substrings": op6_substrings}
ORACLE_SQL: dict[str, str] = {}

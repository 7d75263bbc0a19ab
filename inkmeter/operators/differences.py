"""Alignments as rows, counted differences, and the segments they come from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.functions import kernels


def alignment_rows(pairs: DataFrame, alignment: str, *keys: str) -> DataFrame:
    """``(*keys, pos, gt, ocr)``, one row for each aligned pair of tokens."""
    return pairs.select(*keys, F.posexplode(alignment).alias("pos", "_a")).select(*keys, "pos", "_a.gt", "_a.ocr")


def is_difference() -> Column:
    return ~F.col("gt").eqNullSafe(F.col("ocr"))


def count_differences(pairs: DataFrame, alignment: str, *keys: str, level: str | None = None) -> DataFrame:
    """``(*keys[, level], gt, ocr, n)``: how often each unequal pair of tokens occurs; a missing token is null."""
    rows = alignment_rows(pairs, alignment, *keys).filter(is_difference())
    found = rows.groupBy(*keys, "gt", "ocr").agg(F.count("*").alias("n"))
    return found if level is None else found.select(*keys, F.lit(level).alias("level"), "gt", "ocr", "n")


def key_of(gt: Column, ocr: Column) -> Column:
    """The report's key of a difference; a missing token is spelt ``None``."""
    return F.concat(F.coalesce(gt, F.lit("None")), F.lit(" :: "), F.coalesce(ocr, F.lit("None")))


def difference_map(alignment: Column) -> Column:
    """Counted differences of one alignment as a map, in order of first occurrence, without leaving the row.

    Only the differing pairs' keys are handed to Python, which counts them in one pass.
    """
    keys = F.transform(F.filter(alignment, lambda a: ~a["gt"].eqNullSafe(a["ocr"])), lambda a: key_of(a["gt"], a["ocr"]))
    return F.map_from_entries(_counted(keys))


_COUNTED = T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.LongType())]), False)


@F.pandas_udf(_COUNTED)
def _counted(keys: pd.Series) -> pd.Series:
    return keys.map(lambda own: [{"key": k, "value": n} for k, n in Counter(own).items()], na_action="ignore")


def count_text_differences(pairs: DataFrame, gt: str = "gt", ocr: str = "ocr") -> DataFrame:
    """``(level, gt, ocr, n)`` over all pairs of texts, composed first, for clusters and words.

    Texts are aligned where they lie, and each Arrow batch leaves a task as its distinct differences: no alignment
    crosses into the JVM and no matching token is ever a row. Pairs with a null side count nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x is None or y is None or x == y:
                    continue
                x, y = kernels.nfc(x), kernels.nfc(y)
                for level, tokens in (("character_level", kernels.graphemes), ("word_level", kernels.words)):
                    found.update((level, *pair) for pair in kernels.differing(tokens(x), tokens(y)))
            rows = list(found)
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(found.values()), pa.int64())], ["level", "gt", "ocr", "n"])

    counted = pairs.select(gt, ocr).mapInArrow(run, "level string, gt string, ocr string, n long")
    return counted.groupBy("level", "gt", "ocr").agg(F.sum("n").alias("n"))


def segment_spans(segments: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, seq, segment_id, start, end)``: code-point extents of segments joined by one line break each."""
    before = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return segments.select(*keys, "seq", "segment_id", start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"))


def differences_in_segments(rows: DataFrame, spans: DataFrame, *keys: str, side: str = "gt") -> DataFrame:
    """Differing alignment rows with the id of the segment that their ``side`` lies in.

    ``rows`` are ``alignment_rows`` of clusters; offsets count the code points before a row on its side. Joiners
    and rows without a token on that side get null.
    """
    before = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum(F.length(side)).over(before), F.lit(0))).filter(is_difference())
    inside = [placed[k] == spans[k] for k in keys]
    inside += [placed[side].isNotNull(), placed["_at"] >= spans["start"], placed["_at"] < spans["end"]]
    return placed.join(spans, inside, "left").select(*[placed[c] for c in rows.columns], spans["segment_id"].alias(f"{side}_segment_id"))

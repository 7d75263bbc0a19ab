"""Pairing ground truth with recognised files: joins on names, on stems, on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmeter.functions.strings import common_suffix, removesuffix


def _sided(df: DataFrame, side: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, F.struct(*df.columns).alias(side))


def _name(key: str, by_stem: bool) -> Column:
    """The name that files pair by: their own, or its stem up to the first dot."""
    return F.regexp_replace(key, r"\..*$", "") if by_stem else F.col(key)


def with_partner(files: DataFrame, others: DataFrame, key: str = "file_name", by_stem: bool = False) -> DataFrame:
    """The files whose name the other folder holds as well; of the others only names are read."""
    names = others.select(_name(key, by_stem).alias("_key"))
    return files.withColumn("_key", _name(key, by_stem)).join(names, "_key", "left_semi").drop("_key")


def pair_by_name(gt: DataFrame, ocr: DataFrame, key: str = "file_name", by_stem: bool = False) -> DataFrame:
    """``(key, gt, ocr)`` of the files that both folders hold under one name, or one stem up to the first dot."""
    name = _name(key, by_stem)
    return _sided(gt.withColumn("_key", name), "gt", ("_key",)).join(_sided(ocr.withColumn("_key", name), "ocr", ("_key",)), "_key").withColumnRenamed("_key", key)


def unpaired(gt: DataFrame, ocr: DataFrame, key: str = "file_name") -> DataFrame:
    """Ground-truth files without a partner; recognised files without one are of no interest."""
    return gt.join(ocr.select(key), key, "left_anti")


def pair_by_suffix(gt: DataFrame, ocr: DataFrame, gt_suffix: str, ocr_suffix: str, key: str = "rel_path", strict: bool = True) -> DataFrame:
    """``(stem, gt, ocr)``: every ground-truth file that ends in its suffix, and the file of that stem with the other suffix.

    A missing partner raises when the result is read (``strict``), or leaves a null.
    """
    stem = lambda suffix: removesuffix(F.col(key), F.lit(suffix))
    left = _sided(gt.filter(F.endswith(key, F.lit(gt_suffix))).withColumn("stem", stem(gt_suffix)), "gt", ("stem",))
    right = _sided(ocr.filter(F.endswith(key, F.lit(ocr_suffix))).withColumn("stem", stem(ocr_suffix)), "ocr", ("stem",))
    found = left.join(right, "stem", "left")
    if not strict:
        return found
    message = F.concat(F.lit("no file for "), F.col("stem"), F.lit(ocr_suffix))
    return found.withColumn("ocr", F.when(F.col("ocr").isNotNull(), F.col("ocr")).otherwise(F.raise_error(message).cast(right.schema["ocr"].dataType)))


def suffix_of(files: DataFrame, key: str = "path") -> str:
    """Longest common ending of all names: one aggregated row reaches the driver."""
    found = files.agg(common_suffix(F.col(key))).first()[0]
    if not found:
        raise RuntimeError("the files have no common suffix")
    return found


def pair_by_detected_suffix(gt: DataFrame, ocr: DataFrame, key: str = "rel_path", strict: bool = True) -> DataFrame:
    """Pairs by the longest endings that the names of each side share."""
    return pair_by_suffix(gt, ocr, suffix_of(gt, key), suffix_of(ocr, key), key, strict)


def pair_pages(files: DataFrame, gt_group: str, ocr_group: str) -> DataFrame:
    """``(page_id, gt, ocr)`` of the pages that both file groups of a workspace hold."""
    keep = ("path", "page_id")
    side = lambda group, name: _sided(files.filter((F.col("file_grp") == group) & F.col("page_id").isNotNull()), name, keep)
    return side(gt_group, "gt").join(side(ocr_group, "ocr"), list(keep)).drop("path")

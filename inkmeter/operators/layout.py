"""Relational forms of the page-layout operators, for layouts that are already tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick_equiv(equivs: DataFrame, *keys: str) -> DataFrame:
    """One text alternative a segment from ``(*keys, pos, index, conf, text)``.

    The least index wins; where no alternative has one, the greatest confidence; ties and bare lists go to
    the first position. NaN counts as missing.
    """
    seen = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    own = W.partitionBy(*keys)
    marked = equivs.withColumns({"_index": seen("index"), "_conf": seen("conf")}).withColumn("_any", F.max(F.col("_index").isNotNull()).over(own))
    order = own.orderBy(F.asc_nulls_last("_index"), F.desc_nulls_last(F.when(~F.col("_any"), F.col("_conf"))), "pos")
    return marked.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_index", "_conf", "_any", "_nth")


def reading_order(refs: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, seq, region_id, text)``: regions in the order of their references ``(key, index, region_ref)``.

    References without an index, or to regions that do not exist, are dropped, as are regions without text;
    of regions sharing an id the first by ``pos`` counts.
    """
    first = regions.groupBy(key, "region_id").agg(F.min_by("text", "pos").alias("text"))
    found = refs.filter(F.col("index").isNotNull()).join(first.withColumnRenamed("region_id", "region_ref"), [key, "region_ref"]).filter("text <> ''")
    seq = F.row_number().over(W.partitionBy(key).orderBy("index")) - 1
    return found.select(key, seq.alias("seq"), F.col("region_ref").alias("region_id"), "text")


def join_segments(segments: DataFrame, *keys: str, joiner: str = "\n") -> DataFrame:
    """``(*keys, text)``: the segments of each document in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda s: s["text"]), joiner).alias("text"))

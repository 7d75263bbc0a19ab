"""Fixtures that every dealt operator meets: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("key", "value", "part", "shard", "block", "fp", "anchor", "home", "root", "least", "tokens", "weight", "epochs", "whole", "last", "id",
           "place", "spans", "found", "owner", "score", "payload", "sha1", "v", "cell", "band", "length", "size", "order_key", "data", "doc", "cuts", "t",
           "row", "own", "of", "rule", "copies", "guess", "_copies", "_tokens", "_weight", "_hit_id", "_hit_spans", "_gone", "_again", "_ink_guess", "_ink_lang",
           "lang_pred", "label", "component_id", "h", "w", "d", "hit", "stays", "nth", "s")


def docs(spark, rows, extra: bool = False):
    """``rows`` of (doc_id, text[, lang, source]); with ``extra``, clashing columns that hold junk."""
    rows = [(*r, *(["en", "src0"][len(r) - 2 :]), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("junk").alias(c) for c in CLASHES])
    return df


def awkward(spark, extra: bool = True):
    """A table that holds every awkward case at once."""
    long = "the quick brown fox jumps over the lazy dog again and again. " * 4000
    rows = [
        (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, long), (6, long), (6, long), (7, "short text here", None, None),
        (None, "a row without an id", None, "src1"), (None, None, None, None), (8, "12345 ... !!"), (9, "émigré naïve 日本語 😀 text", "fr", "src2"),
    ]
    return docs(spark, rows, extra)


def rows_of(df):
    return [tuple(r) for r in df.collect()]

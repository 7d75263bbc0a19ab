"""Column functions for Unicode text: normal form, historical-print substitutions, clusters, words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

# Ligatures of historical prints and what they stand for, in order of application.
LIGATURES = (
    ("\ueba6", "\u017f\u017f"), ("\ueba7", "\u017f\u017fi"), ("\uf502", "ch"), ("\ueec4", "ck"), ("\uf4f9", "ll"), ("\ueba2", "\u017fi"),
    ("\ueada", "\u017ft"), ("\ufb01", "fi"), ("\ufb00", "ff"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ueec5", "ct"), ("\ueedc", "tz"),
    ("\uf532", "as"), ("\uf533", "is"), ("\uf534", "us"), ("\uf535", "Qu"), ("\u0133", "ij"), ("\ue8bf", "q&"), ("\ueba5", "\u017fp"), ("\ufb06", "st"),
)
# Equivalent spellings, in order of application after the ligatures.
EQUIVALENCES = (
    ("\ue72b", "\u00fc"), ("\ue42c", "\u00e4"), ("==", "\u2013"), ("\u2014", "\u2013"), ("\ue644", "\u00f6"), ("\u2019", "'"), ("\u2e17", "-"),
    ("a\u0364", "\u00e4"), ("o\u0364", "\u00f6"), ("u\u0364", "\u00fc"), ("\uf50e", "q\u0301"),
)
FORMS = ("nfc", "nfc_sbb")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(kernels.nfc, na_action="ignore")


def nfc(text: Column | str) -> Column:
    """Canonical composition. Only texts with a character from U+0300 on are sent to Python; others are composed already."""
    text = _column(text)
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


def unjoin_ligatures(text: Column | str) -> Column:
    text = nfc(text)
    for old, new in LIGATURES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def nfc_sbb(text: Column | str) -> Column:
    """Composition, ligatures, equivalences, and composition again, since a substitution may leave a mark to compose."""
    text = unjoin_ligatures(text)
    for old, new in EQUIVALENCES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return nfc(text)


def normalize(text: Column | str, form: str = "nfc_sbb") -> Column:
    if form not in FORMS:
        raise NotImplementedError(f"normal form {form}")
    return nfc(text) if form == "nfc" else nfc_sbb(text)


def graphemes(text: Column | str) -> Column:
    """Extended grapheme clusters, on the JVM."""
    return F.regexp_extract_all(_column(text), F.lit(r"(?s)\X"), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(kernels.words, na_action="ignore")


def words(text: Column | str) -> Column:
    """UAX #29 words that hold a word-like character; private-use characters count as letters."""
    return _words(_column(text))


def words_normalized(text: Column | str) -> Column:
    return words(nfc(text))


def plain_value(text: str, form: str = "nfc_sbb") -> str:
    """The same normal forms for one Python string."""
    if form not in FORMS:
        raise NotImplementedError(f"normal form {form}")
    text = kernels.nfc(text)
    if form == "nfc_sbb":
        for old, new in LIGATURES + EQUIVALENCES:
            text = text.replace(old, new)
        text = kernels.nfc(text)
    return text


def is_normal(text: Column | str, form: str = "nfc_sbb") -> Column:
    """Whether a text is composed and a fixed point of its normal form."""
    text = _column(text)
    return text == normalize(text, form)


def check_segment(text: Column, segment_id: Column, joiner: Column, form: str = "nfc_sbb") -> Column:
    """Null, or what is wrong with a segment: text not in normal form, a malformed id, an unknown joiner."""
    return (
        F.when(text.isNotNull() & ~is_normal(text, form), F.lit("text is not normalized"))
        .when(segment_id.isNotNull() & ~segment_id.rlike(r"(?U)^[\w_-]+"), F.lit("segment id is malformed"))
        .when(joiner.isNotNull() & ~joiner.isin("", " ", "\n"), F.lit("unknown joiner"))
    )


def register(spark: SparkSession) -> None:
    """Makes the Arrow functions callable from SQL."""
    spark.udf.register("nfc", _nfc)
    spark.udf.register("unicode_words", _words)

"""Column functions over token arrays: edit distance, edit scripts, alignments, error rates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .unicode_text import _column

#: Product of lengths from which a pair goes to the bit-parallel kernel instead of the JVM's ``levenshtein``.
KERNEL_CELLS = 250_000
_ALIGNMENT = T.ArrayType(T.StructType([T.StructField("gt", T.StringType()), T.StructField("ocr", T.StringType())]))
_EDITOPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("src_pos", T.IntegerType()), T.StructField("dest_pos", T.IntegerType())]))


def _lists(a: pd.Series, b: pd.Series):
    for x, y in zip(a, b, strict=True):
        yield (None, None) if x is None or y is None else (x.tolist() if hasattr(x, "tolist") else x, y.tolist() if hasattr(y, "tolist") else y)


@F.pandas_udf(T.IntegerType())
def _kernel_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else kernels.distance(x, y) for x, y in _lists(a, b)], dtype="Int32")


def _aligned(tokens) -> Callable:
    """An Arrow function that aligns two columns; ``tokens`` makes token lists of their values."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right, offsets = [], [], [0]
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x is None or y is None:
                offsets[-1:] = [None, offsets[-1]]
                continue
            for g, o in kernels.align(tokens(x), tokens(y)):
                left.append(g)
                right.append(o)
            offsets.append(len(left))
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["gt", "ocr"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _ALIGNMENT)


@F.pandas_udf(_EDITOPS)
def _kernel_editops(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"op": o, "src_pos": p, "dest_pos": q} for o, p, q in kernels.edit_script(x, y)] for x, y in _lists(a, b)])


@F.pandas_udf(_EDITOPS)
def _text_editops(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else [{"op": o, "src_pos": p, "dest_pos": q} for o, p, q in kernels.edit_script(_clusters(x), _clusters(y))] for x, y in zip(a, b, strict=True)])


#: The characters that stand for the first distinct tokens of a pair; further ones are made from their number.
_ALPHABET = tuple(chr(0x4E00 + i) for i in range(256))


def jvm_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two arrays without leaving the JVM: every distinct token of the pair becomes one character.

    The pair and its distinct tokens are bound to lambda variables, so that they are computed once a row.
    """
    a, b = _column(a), _column(b)

    def spelt(tokens: Column, known: Column) -> Column:
        def letter(t: Column) -> Column:
            at = F.array_position(known, t).cast("int") - 1
            far = F.decode(F.unhex(F.lpad(F.hex(at + 0x10000), 8, "0")), "UTF-32")
            return F.coalesce(F.get(F.array(*map(F.lit, _ALPHABET)), at), far)

        return F.array_join(F.transform(tokens, letter), "")

    def of_pair(pair: Column) -> Column:
        one = F.transform(F.array(F.array_union(pair["a"], pair["b"])), lambda known: F.levenshtein(spelt(pair["a"], known), spelt(pair["b"], known)))
        return F.get(one, F.lit(0))

    pair = F.when(a.isNotNull() & b.isNotNull(), F.array(F.struct(a.alias("a"), b.alias("b"))))
    return F.get(F.transform(pair, of_pair), F.lit(0))


def seq_distance(a: Column | str, b: Column | str, kernel_cells: int = KERNEL_CELLS) -> Column:
    """Levenshtein distance of token arrays: short pairs on the JVM, long ones by the bit-parallel kernel.

    Equal arrays cost nothing and an empty side counts the other's tokens. Null if either side is null.
    """
    a, b = _column(a), _column(b)
    cells = F.size(a).cast("long") * F.size(b)
    trivial = F.when(a == b, F.lit(0)).when((F.size(a) == 0) | (F.size(b) == 0), F.size(a) + F.size(b))
    long = (cells >= kernel_cells) & (a != b)
    return F.coalesce(trivial, F.when(~long, jvm_distance(a, b)), _kernel_distance(F.when(long, a), F.when(long, b)))


# On texts, composition, segmentation and kernel share one trip to Python.

_COUNTED = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("n", T.IntegerType())])


def _clusters(text: str) -> list[str]:
    return kernels.graphemes(kernels.nfc(text))


def _composed_words(text: str) -> list[str]:
    return kernels.words(kernels.nfc(text))


def _counted(tokens) -> Callable:
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                rows.append((None, None))
            else:
                x = tokens(x)
                rows.append((kernels.distance(x, tokens(y)), len(x)))
        return pd.DataFrame(rows, columns=["d", "n"], dtype="Int32")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, _COUNTED)


_count_clusters, _count_words = _counted(_clusters), _counted(_composed_words)
_kernel_align, _text_align, _text_align_words = _aligned(list), _aligned(_clusters), _aligned(_composed_words)


def _count_characters(a: Column, b: Column) -> tuple[Column, Column]:
    """Distance and reference length in composed clusters.

    Below U+0300, and without CR LF, every code point is a composed cluster of its own, and the JVM's
    ``levenshtein`` counts right; other pairs, and long ones, go to the kernel.
    """
    simple = ~(a.rlike(_COMPLEX) | b.rlike(_COMPLEX)) & (F.length(a).cast("long") * F.length(b) < KERNEL_CELLS)
    far = _count_clusters(F.when(~simple, a), F.when(~simple, b))
    return F.coalesce(F.when(simple, F.levenshtein(a, b)), far["d"]), F.coalesce(F.when(simple, F.length(a)), far["n"])


_COMPLEX = "[^\\x{0}-\\x{2ff}]|\\r\\n"


def str_distance(a: Column | str, b: Column | str) -> Column:
    """Distance of two texts in composed grapheme clusters."""
    return _count_characters(_column(a), _column(b))[0]


def seq_editops(a: Column | str, b: Column | str) -> Column:
    return _kernel_editops(_column(a), _column(b))


def editops(a: Column | str, b: Column | str) -> Column:
    """Edit operations between two texts, positions counted in clusters."""
    return _text_editops(_column(a), _column(b))


def seq_align(a: Column | str, b: Column | str) -> Column:
    return _kernel_align(_column(a), _column(b))


def align(a: Column | str, b: Column | str) -> Column:
    """Alignment of two texts cluster by cluster."""
    return _text_align(_column(a), _column(b))


def rate(d: Column, n: Column) -> Column:
    """Errors per reference token: 0 without errors, infinite without reference tokens."""
    return F.when(d == 0, F.lit(0.0)).when(n == 0, F.lit(float("inf"))).otherwise(d / F.nullif(n, F.lit(0)))


def metric(reference: Column | str, compared: Column | str) -> Column:
    """``struct<d, n, rate>`` of two token arrays; ``n`` counts the reference alone."""
    d, n = seq_distance(reference, compared), F.size(_column(reference))
    return F.struct(d.alias("d"), n.alias("n"), rate(d, n).alias("rate"))


def _text_metric(d: Column, n: Column) -> Column:
    return F.struct(d.alias("d"), n.alias("n"), rate(d, n).alias("rate"))


def cer(reference: Column | str, compared: Column | str) -> Column:
    """Character error metric of two texts, composed first."""
    return _text_metric(*_count_characters(_column(reference), _column(compared)))


def wer(reference: Column | str, compared: Column | str) -> Column:
    """Word error metric of two texts, composed first."""
    counted = _count_words(_column(reference), _column(compared))
    return _text_metric(counted["d"], counted["n"])


def align_words(a: Column | str, b: Column | str) -> Column:
    """Alignment of two texts word by word."""
    return _text_align_words(_column(a), _column(b))


def score_hint(error_rate: Column, n: Column) -> Column:
    """Expected distance, rounded up; null if it is not finite."""
    expected = error_rate * n
    finite = ~F.isnan(expected) & (F.abs(expected) < float("inf"))
    return F.when(finite, F.ceil(F.when(finite, expected)).cast("int"))


def register(spark: SparkSession) -> None:
    """Makes the Arrow kernels callable from SQL."""
    spark.udf.register("seq_distance", _kernel_distance)
    spark.udf.register("seq_align", _kernel_align)
    spark.udf.register("seq_editops", _kernel_editops)

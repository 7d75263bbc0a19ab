"""Files as DataFrames: listings, page and text files to segments and documents, METS workspaces, report folders."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parse

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
SEGMENTS = T.ArrayType(T.StructType(_text("region_id", "segment_id", "text")))
EXTRACTED = T.StructType([*_text("fmt", "error"), T.StructField("segments", SEGMENTS)])
METS_FILES = T.ArrayType(T.StructType(_text("page_id", "file_id", "file_grp", "href", "mimetype")))
_COUNTS = T.MapType(T.StringType(), T.LongType())
REPORT = T.StructType([
    *_text("gt", "ocr"), T.StructField("cer", T.DoubleType()), T.StructField("wer", T.DoubleType()),
    T.StructField("differences", T.StructType([T.StructField("character_level", _COUNTS), T.StructField("word_level", _COUNTS)])),
    T.StructField("n_characters", T.LongType()), T.StructField("n_words", T.LongType()),
])


def read_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None, hidden: bool = False) -> DataFrame:
    """``(path, rel_path, file_name, content)`` of the files at a path, a folder or a glob; an empty file has empty content.

    Names with a leading dot are left out unless ``hidden``; Spark itself passes over folders whose names
    start with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    place = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    name = F.element_at(F.split("path", "/"), -1)
    rel = F.when(place.startswith(base + "/"), F.substr(place, F.lit(len(base) + 2))).otherwise(name)
    found = reader.load(path).select("path", "content")
    # the scan passes over files of no bytes, the listing has them; only names are compared
    listed = [(re.sub(r"^(\w+):///(?!/)", r"\1:/", unquote(p)),) for p in found._jdf.inputFiles()]
    names = spark.createDataFrame(listed, "path string")
    empty = names.join(found.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    found = found.unionByName(empty).select("path", rel.alias("rel_path"), name.alias("file_name"), "content")
    return found if hidden else found.filter(~is_hidden("file_name"))


def is_hidden(name: Column | str) -> Column:
    return F.startswith(F.col(name) if isinstance(name, str) else name, F.lit("."))


def extract(content: Column, level: str = "region", encoding: str = "autodetect", form: str = "nfc_sbb", file_name: Column | None = None) -> Column:
    """``struct<fmt, error, segments>`` of binary file contents; with ``file_name``, it leads the ids of plain lines."""

    @F.pandas_udf(EXTRACTED)
    def run(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for c, name in zip(contents, names, strict=True):
            found, error = (None, None) if c is None else parse.guarded(parse.extract, bytes(c), level, encoding, form, f"{name} - " if name else "")
            kind, segments = found or (None, None)
            rows.append({"fmt": kind, "error": error, "segments": None if segments is None else [dict(zip(("region_id", "segment_id", "text"), s, strict=True)) for s in segments]})
        return pd.DataFrame(rows, columns=["fmt", "error", "segments"])

    return run(content, F.lit("") if file_name is None else file_name)


def documents(files: DataFrame, level: str = "region", encoding: str = "autodetect", form: str = "nfc_sbb", names_in_ids: bool = False) -> DataFrame:
    """One row a file: its other columns, ``fmt, error, segments`` and ``text``, the segments joined by line breaks."""
    found = files.withColumn("_found", extract(F.col("content"), level, encoding, form, F.col("file_name") if names_in_ids else None)).drop("content")
    return found.select(*[c for c in found.columns if c != "_found"], "_found.*").withColumn(
        "text", F.array_join(F.transform("segments", lambda s: s["text"]), "\n"))


def segments(docs: DataFrame, *keys: str) -> DataFrame:
    """One row a segment: the keys, ``seq, region_id, segment_id, text``."""
    return docs.select(*keys, F.posexplode("segments").alias("seq", "_s")).select(*keys, "seq", "_s.*")


def plain_lines(files: DataFrame) -> DataFrame:
    """Lines of UTF-8 text files on the JVM: ``(path, line_no, segment_id, text)``, stripped, not normalised."""
    text = F.decode("content", "UTF-8")
    parts = F.split(text, "\r\n|\r|\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    strip = lambda c: F.regexp_replace(c, r"^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$", "")
    return files.select("path", F.posexplode(kept).alias("line_no", "line")).select(
        "path", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("segment_id"), strip(F.col("line")).alias("text"))


def detect_encoding(content: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: parse.detect_encoding(bytes(c)), na_action="ignore")

    return run(content)


def mets_files(files: DataFrame) -> DataFrame:
    """Files of METS documents: ``(path, page_id, file_id, file_grp, href, mimetype)``."""

    @F.pandas_udf(METS_FILES)
    def run(contents: pd.Series) -> pd.Series:
        names = ("page_id", "file_id", "file_grp", "href", "mimetype")
        return contents.map(lambda c: [dict(zip(names, row, strict=True)) for row in parse.mets_files(bytes(c))], na_action="ignore")

    return files.select("path", F.inline(run(F.col("content"))))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Report files of a folder with ``path``; a rate that is missing or null is null. Bare ``Infinity`` is a number."""
    reader = spark.read.schema(REPORT).option("multiLine", "true").option("allowNonNumericNumbers", "true").option("pathGlobFilter", "*.json")
    return reader.json(folder).withColumn("path", F.input_file_name())

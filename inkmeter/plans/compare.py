"""Comparison plans: pairs of texts to metrics, alignments, differences and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.functions.distance import align, align_words, cer, rate, wer
from inkmeter.operators import aggregate, pairing
from inkmeter.sinks import html
from inkmeter.sinks.files import report_json, write_file, write_pieces, write_rows
from inkmeter.sources.files import documents, read_files


def measure(pairs: DataFrame, gt: str = "gt_text", ocr: str = "ocr_text", alignments: bool = False) -> DataFrame:
    """``pairs`` with ``c_dist, n_characters, cer, w_dist, n_words, wer`` of two text columns in normal form.

    With ``alignments`` also ``c_align`` and ``w_align``; the distances are then counted from them, so that the
    matrix is computed once.
    """
    if alignments:
        placed = pairs.withColumns({"c_align": align(gt, ocr), "w_align": align_words(gt, ocr)})
        errors = lambda a: F.size(F.filter(a, lambda x: ~x["gt"].eqNullSafe(x["ocr"])))
        length = lambda a: F.size(F.filter(a, lambda x: x["gt"].isNotNull()))
        counted = placed.withColumns({"c_dist": errors("c_align"), "n_characters": length("c_align"), "w_dist": errors("w_align"), "n_words": length("w_align")})
    else:
        found = pairs.withColumns({"_c": cer(gt, ocr), "_w": wer(gt, ocr)})
        counted = found.withColumns({"c_dist": F.col("_c.d"), "n_characters": F.col("_c.n"), "w_dist": F.col("_w.d"), "n_words": F.col("_w.n")}).drop("_c", "_w")
    return counted.withColumns({"cer": rate(F.col("c_dist"), F.col("n_characters")), "wer": rate(F.col("w_dist"), F.col("n_words"))})


def render(measured: DataFrame, metrics: bool = True, differences: bool = False) -> DataFrame:
    """``(name, json, html)`` of measured pairs with alignments and the columns ``name, gt_path, ocr_path, gt_segments, ocr_segments``."""

    @F.pandas_udf(T.StringType())
    def page(rows: pd.DataFrame) -> pd.Series:
        pairs = lambda a: [(x["gt"], x["ocr"]) for x in a]
        ids = lambda s: [(x["segment_id"], x["text"]) for x in s]
        return pd.Series([
            html.report_page(r.gt_path, r.ocr_path, r.cer, r.wer, r.n_characters, r.n_words, pairs(r.c_align), pairs(r.w_align), ids(r.gt_segments), ids(r.ocr_segments), metrics, differences)
            for r in rows.itertuples()], dtype=object)

    used = ("gt_path", "ocr_path", "cer", "wer", "n_characters", "n_words", "c_align", "w_align", "gt_segments", "ocr_segments")
    counts = (F.col("c_align"), F.col("w_align")) if differences else (None, None)
    js = report_json(F.col("gt_path"), F.col("ocr_path"), F.col("cer"), F.col("wer"), F.col("n_characters"), F.col("n_words"), *counts, metrics=metrics)
    return measured.select("name", js.alias("json"), page(F.struct(*used)).alias("html"))


def _sides(pairs: DataFrame, name: str) -> DataFrame:
    side = lambda s: [F.col(f"{s}.path").alias(f"{s}_path"), F.col(f"{s}.segments").alias(f"{s}_segments"), F.col(f"{s}.text").alias(f"{s}_text")]
    return pairs.select(F.col(name).alias("name"), *side("gt"), *side("ocr"))


def raise_errors(docs: DataFrame) -> DataFrame:
    """Documents, failing on the first that could not be read."""
    message = F.concat(F.col("path"), F.lit(": "), F.col("error"))
    return docs.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(message).cast("string")))


def compare_pairs(pairs: DataFrame, name: str, folder: str, prefix: str, metrics: bool, differences: bool) -> DataFrame:
    """Writes the two reports of every pair ``(name, gt, ocr)`` of documents; returns ``name, json_path, html_path``."""
    reports = render(measure(_sides(pairs, name), alignments=True), metrics, differences)
    base = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("name"), F.lit(prefix))
    file = lambda kind: F.struct(F.concat(base, F.lit(f".{kind}")).alias("path"), F.col(kind).alias("content"))
    write_rows(reports.select("name", F.inline(F.array(file("json"), file("html")))))
    return pairs.select(F.col(name).alias("name"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name), F.lit(prefix + ".json")).alias("json_path"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name), F.lit(prefix + ".html")).alias("html_path"))


def compare_files(spark: SparkSession, gt: str, ocr: str, report_prefix: str = "report", reports_folder: str = ".", *, metrics: bool = True, differences: bool = False,
                  textequiv_level: str = "region", plain_encoding: str = "autodetect") -> None:
    """Compares two files and writes ``{prefix}.json`` and ``{prefix}.html``."""
    side = lambda path: raise_errors(documents(read_files(spark, path, hidden=True), textequiv_level, plain_encoding)).withColumn("_one", F.lit(""))
    compare_pairs(pairing.pair_by_name(side(gt), side(ocr), "_one"), "_one", reports_folder, report_prefix, metrics, differences)


def compare_dirs(spark: SparkSession, gt: str, ocr: str, report_prefix: str = "report", reports_folder: str = ".", *, metrics: bool = True, differences: bool = False,
                 textequiv_level: str = "region", plain_encoding: str = "autodetect", by_stem: bool = False) -> DataFrame:
    """Compares files of equal name in two folders; returns the ``file_name`` of ground truth without a partner."""
    side = lambda path: read_files(spark, path, hidden=True)
    files = {s: side(path) for s, path in (("gt", gt), ("ocr", ocr))}
    # names meet first, so that a file without a partner is neither read nor able to fail
    docs = {s: raise_errors(documents(pairing.with_partner(files[s], files[o], by_stem=by_stem), textequiv_level, plain_encoding)) for s, o in (("gt", "ocr"), ("ocr", "gt"))}
    pairs = pairing.pair_by_name(docs["gt"], docs["ocr"], by_stem=by_stem)
    compare_pairs(pairs, "file_name", reports_folder, f"-{report_prefix}", metrics, differences)
    return pairing.unpaired(files["gt"], files["ocr"]).select("file_name")


def _line_page(measured: DataFrame, total, metrics: bool) -> Iterator[str]:
    """The HTML of all pairs, piece by piece in the order of their names."""
    yield html.head("Comparison of recognised lines")
    yield html.rates(total.cer, total.wer, total.n_characters, total.n_words) if metrics else ""
    for k, r in enumerate(measured.orderBy("name").toLocalIterator()):
        for kind, a, spans in (("c", r.c_align, [html.spans_of((s.segment_id, s.text) for s in x) for x in (r.gt_segments, r.ocr_segments)]), ("w", r.w_align, [(), ()])):
            yield html.pair_block(html.fragments([(x.gt, x.ocr) for x in a], f"l{k}-{kind}", kind, *spans), not metrics)
    yield html.foot()


def compare_line_dirs(spark: SparkSession, gt: str, ocr: str, report_prefix: str = "report", *, metrics: bool = True, gt_suffix: str | None = None, ocr_suffix: str | None = None,
                      plain_encoding: str = "autodetect", parity: bool = False) -> DataFrame:
    """Compares two trees of line files and writes one report for all; returns its one row of corpus rates.

    The HTML goes into its file pair by pair as partitions arrive, so the driver holds one partition at a time.
    """
    side = lambda path: read_files(spark, path, recursive=True)
    files = (side(gt), side(ocr))
    if gt_suffix is None or ocr_suffix is None:
        gt_suffix, ocr_suffix = (pairing.suffix_of(f, "path") for f in files)
    docs = [raise_errors(documents(f, "region", plain_encoding, names_in_ids=True)) for f in files]
    pairs = pairing.pair_by_suffix(*docs, gt_suffix, ocr_suffix)
    measured = measure(_sides(pairs, "stem"), alignments=True).persist()
    try:
        total = aggregate.corpus_rates(measured, parity=parity).first()
        if not total.n_characters and not measured.take(1):
            raise RuntimeError("there are no pairs to compare")
        rates = spark.createDataFrame([total])
        js = rates.select(report_json(F.lit(gt), F.lit(ocr), F.col("cer"), F.col("wer"), F.col("n_characters"), F.col("n_words"), metrics=metrics)).first()[0]
        write_file(f"{report_prefix}.json", js)
        write_pieces(f"{report_prefix}.html", _line_page(measured, total, metrics))
        return rates
    finally:
        measured.unpersist()

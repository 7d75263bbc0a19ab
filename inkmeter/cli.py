"""Commands: ``python -m inkmeter.cli compare|line-dirs|extract|summarize|workspace``."""

from __future__ import annotations

import argparse
import json
import os
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkmeter")
    sub = p.add_subparsers(dest="command", required=True)
    yes_no = argparse.BooleanOptionalAction

    c = sub.add_parser("compare", help="compare two files, or the files of equal name in two folders")
    c.add_argument("gt")
    c.add_argument("ocr")
    c.add_argument("report_prefix", nargs="?", default="report")
    c.add_argument("reports_folder", nargs="?", default=".")
    c.add_argument("--differences", action=yes_no, default=False)
    d = sub.add_parser("line-dirs", help="compare two trees of line files")
    d.add_argument("gt")
    d.add_argument("ocr")
    d.add_argument("report_prefix", nargs="?", default="report")
    d.add_argument("--gt-suffix")
    d.add_argument("--ocr-suffix")
    e = sub.add_parser("extract", help="print the text of a file")
    e.add_argument("input_file")
    s = sub.add_parser("summarize", help="summarize a folder of reports")
    s.add_argument("reports_folder", nargs="?", default="./reports")
    s.add_argument("--occurrences-threshold", type=int, default=1)
    w = sub.add_parser("workspace", help="compare two file groups of a METS workspace")
    w.add_argument("mets")
    w.add_argument("gt_group")
    w.add_argument("ocr_group")
    w.add_argument("out_group")
    w.add_argument("--parameters", help="a JSON object of parameters, or a file that holds one; they go before the other options")
    sub.add_parser("describe", help="print the parameters of the workspace evaluation as JSON")
    w.add_argument("--overwrite", action="store_true")
    w.add_argument("--missing", choices=("abort", "skip"), default="abort")
    for x in (c, d, w):
        x.add_argument("--metrics", action=yes_no, default=True)
    for x in (c, e, w):
        x.add_argument("--textequiv-level", choices=("region", "line"), default="region")
    for x in (c, d, e, w):
        x.add_argument("--plain-encoding", default="autodetect")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "extract":
        from inkmeter.api import extract

        print(extract(a.input_file, textequiv_level=a.textequiv_level, plain_encoding=a.plain_encoding).text)
        return 0
    if a.command == "describe":
        from inkmeter.plans.workspace import DESCRIPTION

        print(json.dumps(DESCRIPTION, indent=1))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("inkmeter").getOrCreate()
    from inkmeter.plans import compare, summarize, workspace

    if a.command == "compare":
        how = {"metrics": a.metrics, "differences": a.differences, "textequiv_level": a.textequiv_level, "plain_encoding": a.plain_encoding}
        if os.path.isdir(a.gt) != os.path.isdir(a.ocr):
            print("compare two files or two folders", file=sys.stderr)
            return 2
        if os.path.isdir(a.gt):
            for r in compare.compare_dirs(spark, a.gt, a.ocr, a.report_prefix, a.reports_folder, **how).toLocalIterator():
                print(f"Skipping {r.file_name}: there is no such recognised file")
        else:
            compare.compare_files(spark, a.gt, a.ocr, a.report_prefix, a.reports_folder, **how)
    elif a.command == "line-dirs":
        compare.compare_line_dirs(spark, a.gt, a.ocr, a.report_prefix, metrics=a.metrics, gt_suffix=a.gt_suffix, ocr_suffix=a.ocr_suffix, plain_encoding=a.plain_encoding)
    elif a.command == "summarize":
        found = summarize.summarize(spark, a.reports_folder, a.occurrences_threshold)
        print("There are no reports" if found is None else found.select("num_reports", "cer_avg", "wer_avg", "cer_sum", "wer_sum").first().asDict())
    else:
        how = {"metrics": a.metrics, "textequiv_level": a.textequiv_level, "plain_encoding": a.plain_encoding}
        if a.parameters:
            text = a.parameters if a.parameters.lstrip().startswith("{") else open(a.parameters, encoding="utf-8").read()
            how = workspace.parameters(json.loads(text))
        workspace.evaluate(spark, a.mets, a.gt_group, a.ocr_group, a.out_group, **how, missing=a.missing, overwrite=a.overwrite)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Evaluation of a METS workspace: two file groups compared page by page, reports registered as a third."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.operators.pairing import pair_pages
from inkmeter.plans.compare import compare_pairs, raise_errors
from inkmeter.sinks.files import open_fs
from inkmeter.sources.files import documents, mets_files, read_files
from inkmeter.sources.parse import split_name

#: What a workflow engine needs to know of the workspace evaluation: its file groups and its parameters with their defaults.
DESCRIPTION = {
    "executable": "python -m inkmeter.cli workspace",
    "description": "Compares two file groups of a workspace page by page and registers the reports as a third",
    "input_file_groups": 2,
    "output_file_groups": 1,
    "parameters": {
        "metrics": {"type": "boolean", "default": True, "description": "whether reports hold error rates"},
        "textequiv_level": {"type": "string", "enum": ["region", "line"], "default": "region", "description": "the level of page files that texts are taken from"},
        "plain_encoding": {"type": "string", "default": "autodetect", "description": "the encoding of plain text files"},
    },
}
MIMETYPES = {"json": "application/json", "html": "text/html"}


def register_outputs(mets: bytes, group: str, rows: list[tuple[str, str, str, str]], overwrite: bool = False) -> bytes:
    """METS bytes with files ``(file id, page id, media type, location)`` added to a group and to their pages."""
    root = ET.fromstring(mets)
    space = split_name(root.tag)[0]
    tag = lambda name: f"{{{space}}}{name}" if space else name
    xlink = "http://www.w3.org/1999/xlink"
    ET.register_namespace("mets", space)
    ET.register_namespace("xlink", xlink)
    known = {f.get("ID"): (g, f) for g in root.iter(tag("fileGrp")) for f in g.findall(tag("file"))}
    pages = {d.get("ID"): d for d in root.iter(tag("div")) if d.get("TYPE") == "page"}
    section = root.find(tag("fileSec"))
    section = ET.SubElement(root, tag("fileSec")) if section is None else section
    own = next((g for g in section.findall(tag("fileGrp")) if g.get("USE") == group), None)
    own = ET.SubElement(section, tag("fileGrp"), {"USE": group}) if own is None else own
    for file_id, page_id, mimetype, href in rows:
        if file_id in known:
            if not overwrite:
                raise FileExistsError(f"the workspace has a file {file_id} already")
            known[file_id][0].remove(known[file_id][1])
        file = ET.SubElement(own, tag("file"), {"ID": file_id, "MIMETYPE": mimetype})
        ET.SubElement(file, tag("FLocat"), {"LOCTYPE": "OTHER", "OTHERLOCTYPE": "FILE", f"{{{xlink}}}href": href})
        page = pages.get(page_id)
        if page is not None and all(p.get("FILEID") != file_id for p in page.findall(tag("fptr"))):
            ET.SubElement(page, tag("fptr"), {"FILEID": file_id})
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def manifest(pairs: DataFrame, out_group: str) -> DataFrame:
    """``(file_id, page_id, mimetype, href)`` of the two reports of each page pair."""
    name = F.concat(F.lit(f"{out_group}_"), F.col("page_id"))
    return pairs.select("page_id", name.alias("base"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mimetype")) for k, m in MIMETYPES.items()])).alias("_k")).select(
        F.concat("base", F.lit("-"), F.upper("_k.kind")).alias("file_id"), "page_id", "_k.mimetype", F.concat(F.lit(f"{out_group}/"), "base", F.lit("."), "_k.kind").alias("href"))


def parameters(given: dict) -> dict:
    """``given`` completed by defaults; raises on a parameter that is unknown or of another type or value."""
    known = DESCRIPTION["parameters"]
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"unknown parameter {name}")
        of = {"boolean": bool, "string": str}[known[name]["type"]]
        if not isinstance(value, of) or value not in known[name].get("enum", [value]):
            raise ValueError(f"parameter {name} cannot be {value!r}")
    return {name: given.get(name, p["default"]) for name, p in known.items()}


def evaluate(spark: SparkSession, mets_path: str, gt_group: str, ocr_group: str, out_group: str, *, metrics: bool = True, textequiv_level: str = "region",
             plain_encoding: str = "autodetect", missing: str = "abort", overwrite: bool = False) -> DataFrame:
    """Compares two file groups and registers the reports; returns the manifest.

    Pages that lack a side are skipped. A listed file that is not there aborts, or is skipped with ``missing="skip"``.
    """
    if missing not in ("abort", "skip"):
        raise ValueError("missing must be abort or skip")
    fs, place = open_fs(mets_path)
    folder = place.rpartition("/")[0] or "."
    listed = mets_files(read_files(spark, mets_path))
    pairs = pair_pages(listed, gt_group, ocr_group)
    wanted = pairs.select("page_id", F.explode(F.array(F.struct(F.lit("gt").alias("side"), "gt.href"), F.struct(F.lit("ocr").alias("side"), "ocr.href"))).alias("f")).select("page_id", "f.*")
    base = mets_path.rpartition("/")[0] or "."
    groups = [r.place for r in wanted.select(F.regexp_replace("href", "[^/]*$", "").alias("place")).distinct().collect()]  # folders of two groups
    files = None
    for g in groups:
        one = read_files(spark, f"{base}/{g}".rstrip("/"), hidden=True).withColumn("href", F.concat(F.lit(g), F.col("file_name")))
        files = one if files is None else files.unionByName(one)
    docs = raise_errors(documents(wanted.join(files, "href", "left" if missing == "abort" else "inner"), textequiv_level, plain_encoding))
    gone = F.col("path").isNull()
    docs = docs.withColumn("text", F.when(~gone, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("missing file "), F.col("href"))).cast("string")))
    side = lambda s: docs.filter(F.col("side") == s).select("page_id", F.struct("path", "segments", "text").alias(s))
    both = side("gt").join(side("ocr"), "page_id").withColumn("base", F.concat(F.lit(f"{out_group}_"), F.col("page_id")))
    compare_pairs(both, "base", f"{base}/{out_group}", "", metrics, False)
    rows = manifest(both, out_group)
    with fs.open_input_stream(place) as f:
        mets = f.read()
    done = register_outputs(mets, out_group, [tuple(r) for r in rows.orderBy("file_id").toLocalIterator()], overwrite)
    with fs.open_output_stream(f"{folder}/mets.xml" if place.endswith("mets.xml") else place) as f:
        f.write(done)
    return rows

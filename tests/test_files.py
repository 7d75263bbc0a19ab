"""Files end to end: empty ones, unpaired ones, detected suffixes, commands, value-level readers, tables of few files."""

import html
import json
import math
import re
from collections import Counter

import pytest

from inkmeter import api, cli
from inkmeter.functions import kernels, strings, unicode_text
from inkmeter.plans import compare, registry, workspace
from inkmeter.sinks.files import summary_pieces
from inkmeter.sources import files, staging
from tests.test_documents import recognised

BOM = "﻿"
PAGE = '<PcGts xmlns="ns"><Page><TextRegion id="r"><TextLine id="l"><TextEquiv><Unicode>line text</Unicode></TextEquiv></TextLine><TextEquiv><Unicode>region text</Unicode></TextEquiv></TextRegion></Page></PcGts>'
ALTO = '<alto xmlns="x"><TextLine ID="l"><String CONTENT="a"/><SP/><String CONTENT="b"/></TextLine></alto>'
EMPTY = [("", "Lorem ipsum", math.inf), ("Lorem ipsum", "", 1.0), (BOM, "Lorem ipsum", math.inf), ("Lorem ipsum", BOM, 1.0), ("", "", 0.0), (BOM, "", 0.0), ("", BOM, 0.0)]


def sides(folder, gt, ocr):
    for name, texts in (("gt", gt), ("ocr", ocr)):
        for rel, text in texts.items():
            path = folder / name / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text.encode())
    return str(folder / "gt"), str(folder / "ocr")


def test_empty_files_in_a_folder(spark, tmp_path):
    gt, ocr = sides(tmp_path, {f"{i} x.txt": g for i, (g, _, _) in enumerate(EMPTY)}, {f"{i} x.txt": o for i, (_, o, _) in enumerate(EMPTY)})
    assert compare.compare_dirs(spark, gt, ocr, "report", str(tmp_path / "out")).count() == 0
    for i, (_, _, want) in enumerate(EMPTY):
        assert json.loads((tmp_path / "out" / f"{i} x.txt-report.json").read_text())["cer"] == want


@pytest.mark.parametrize("nth", [0, 1, 4])
def test_an_empty_file_by_itself(spark, tmp_path, nth):
    g, o, want = EMPTY[nth]
    gt, ocr = sides(tmp_path, {"a.txt": g}, {"a.txt": o})
    compare.compare_files(spark, f"{gt}/a.txt", f"{ocr}/a.txt", "one", str(tmp_path))
    assert json.loads((tmp_path / "one.json").read_text())["cer"] == want


def test_empty_files_in_line_trees(spark, tmp_path):
    gt, ocr = sides(tmp_path, {"a/1.gt.txt": "", "a/2.gt.txt": "four"}, {"a/1.ocr.txt": "xyz", "a/2.ocr.txt": ""})
    total = compare.compare_line_dirs(spark, gt, ocr, str(tmp_path / "r"), gt_suffix=".gt.txt", ocr_suffix=".ocr.txt").first()
    assert total.cer == 7 / 4 and total.n_characters == 4
    only = sides(tmp_path / "only", {"1.gt.txt": ""}, {"1.ocr.txt": "xyz"})
    assert compare.compare_line_dirs(spark, *only, str(tmp_path / "r"), gt_suffix=".gt.txt", ocr_suffix=".ocr.txt").first().cer == math.inf


def test_an_empty_page_in_a_workspace(spark, tmp_path):
    for group, text in (("GT", "abc"), ("OCR", "")):
        (tmp_path / group).mkdir()
        (tmp_path / group / "1.txt").write_text(text)
    (tmp_path / "mets.xml").write_text(
        '<m:mets xmlns:m="http://www.loc.gov/METS/" xmlns:x="http://www.w3.org/1999/xlink"><m:fileSec>'
        + "".join(f'<m:fileGrp USE="{g}"><m:file ID="{g}1" MIMETYPE="text/plain"><m:FLocat x:href="{g}/1.txt"/></m:file></m:fileGrp>' for g in ("GT", "OCR"))
        + '</m:fileSec><m:structMap><m:div TYPE="physSequence"><m:div TYPE="page" ID="P1"><m:fptr FILEID="GT1"/><m:fptr FILEID="OCR1"/></m:div></m:div></m:structMap></m:mets>')
    assert cli.main(["workspace", str(tmp_path / "mets.xml"), "GT", "OCR", "EVAL", "--parameters", '{"textequiv_level": "line"}'], spark) == 0
    assert json.loads((tmp_path / "EVAL" / "EVAL_P1.json").read_text())["cer"] == 1.0
    with pytest.raises(ValueError):
        workspace.evaluate(spark, str(tmp_path / "mets.xml"), "GT", "OCR", "X", missing="guess")


def test_parameters_of_the_workspace_evaluation(capsys):
    assert cli.main(["describe"]) == 0 and set(json.loads(capsys.readouterr().out)["parameters"]) == {"metrics", "textequiv_level", "plain_encoding"}
    assert workspace.parameters({"metrics": False}) == {"metrics": False, "textequiv_level": "region", "plain_encoding": "autodetect"}
    for bad in ({"metrics": "no"}, {"textequiv_level": "page"}, {"level": 1}):
        with pytest.raises(ValueError):
            workspace.parameters(bad)


def test_unpaired_files_are_not_read(spark, tmp_path):
    gt, ocr = sides(tmp_path, {"a.txt": "same", "only.txt": "x", "b.gt.txt": "stem"}, {"a.txt": "same", "bad.xml": "<html/>", "b.ocr.txt": "stem"})
    assert {r.file_name for r in compare.compare_dirs(spark, gt, ocr, "report", str(tmp_path / "out")).collect()} == {"only.txt", "b.gt.txt"}
    assert [p.name for p in (tmp_path / "out").glob("*.json")] == ["a.txt-report.json"]
    compare.compare_dirs(spark, gt, ocr, "stems", str(tmp_path / "out"), by_stem=True)
    assert len(list((tmp_path / "out").glob("*-stems.json"))) == 2


def test_line_trees_with_detected_suffixes(spark, tmp_path, capsys):
    gt, ocr = sides(tmp_path, {"a.gt.txt": "This is a test.", "b.gt.txt": "Another test.", ".hidden.gt.txt": "x"}, {"a.some-ocr.txt": "Tis is a test.", "b.some-ocr.txt": "AnÖther test."})
    assert cli.main(["line-dirs", gt, ocr, str(tmp_path / "lines")], spark) == 0
    report = json.loads((tmp_path / "lines.json").read_text())
    assert report["cer"] == 2 / 28 and report["wer"] == 2 / 6 and (report["n_characters"], report["n_words"]) == (28, 6)
    page = (tmp_path / "lines.html").read_text()
    assert page.index("l0-c") < page.index("l0-w") < page.index("l1-c") and page.endswith("</html>\n")
    # decoded as a legacy encoding, the second line has another error
    total = compare.compare_line_dirs(spark, gt, ocr, str(tmp_path / "legacy"), plain_encoding="cp1252", parity=True).first()
    assert abs(total.cer - 3 / 28) < 1e-12
    assert cli.main(["extract", f"{gt}/a.gt.txt"]) == 0 and capsys.readouterr().out.endswith("This is a test.\n")
    assert cli.main(["compare", gt, f"{ocr}/a.some-ocr.txt"], spark) == 2


def test_summaries_stream_their_counts(spark, tmp_path, capsys):
    reports = [
        {"cer": 0.05, "wer": 0.15, "differences": {"character_level": {"a :: b": 10, 'q" :: ü': 2}, "word_level": {"c :: d": 30}}},
        {"cer": 0.10, "wer": 0.20, "differences": {"character_level": {"a :: b": 20}, "word_level": {"c :: d": 40, "e :: f": 1}}},
        {"cer": 0.5, "differences": {"character_level": {"z :: z": 1}, "word_level": {}}}, {"cer": None, "wer": 1.0}]
    for i, r in enumerate(reports):
        (tmp_path / f"{i}.json").write_text(json.dumps(r))
    cli.main(["summarize", str(tmp_path), "--occurrences-threshold", "2"], spark)
    assert "'num_reports': 2" in capsys.readouterr().out
    found = json.loads((tmp_path / "summary.json").read_text())
    assert found == {"num_reports": 2, "cer_avg": pytest.approx(0.075), "wer_avg": pytest.approx(0.175),
                     "differences": {"character_level": {"a :: b": 30, 'q" :: ü': 2}, "word_level": {"c :: d": 70, "e :: f": 1}}}
    page = (tmp_path / "summary.html").read_text()
    assert page.count("<tr><td") == 3 and "1 differences with fewer than 2 occurrences left out" in page
    assert json.loads("".join(summary_pieces({"num_reports": 1, "cer_avg": 0.0, "wer_avg": 0.0}, None))) == {"num_reports": 1}


def test_readers_on_plain_values(tmp_path):
    for name, text in (("p.xml", PAGE), ("a.xml", ALTO), ("t.txt", BOM + " one \n\ntwo"), ("e.txt", "")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    at = lambda name: str(tmp_path / name)
    assert api.text(at("p.xml")) == "region text" and api.extract(at("p.xml"), textequiv_level="line").text == "line text"
    assert api.text(at("a.xml")) == "a b" and api.plain_text(at("t.txt")) == "one\n\ntwo" and api.text(at("e.txt")) == ""
    assert api.page_text(api.ET.fromstring(PAGE)) == "region text" and api.alto_text(api.ET.fromstring(ALTO)) == "a b"
    assert api.distance(api.ExtractedText.from_str("Fnord"), api.ExtractedText.from_str("Food")) == 2
    assert api.extract(at("t.txt")).segment_id_for_pos(5) == "line 2"
    assert api.words("'amour d’une a'e b") == ["amour", "d’une", "a'e", "b"]


@pytest.mark.parametrize("bad", [((("", "x"),), "\n"), ((("a", "ﬁ"),), "\n"), ((("a", "ü"),), "\n"), ((("a", "x"),), "--")])
def test_extracted_texts_are_validated(bad):
    with pytest.raises(ValueError):
        api.ExtractedText(*bad)


def test_small_columns(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("x y/ü~", ["a", "a", None], "ﬁ", "id 1", "-")], "u string, ids array<string>, t string, s string, j string").select(
        strings.url_quote(F.col("u")).alias("u"), strings.segment_id_at(F.col("ids"), F.lit(2)).alias("none"), strings.segment_id_at(F.col("ids"), F.lit(1)).alias("a"),
        strings.invert_map(F.create_map(F.lit("k"), F.lit("v"), F.lit("l"), F.lit("v"))).alias("m"), unicode_text.check_segment(F.col("t"), F.col("s"), F.col("j")).alias("text"),
        unicode_text.check_segment(F.lit("ok"), F.lit("-"), F.col("j")).alias("joiner"), unicode_text.check_segment(F.lit("ok"), F.lit("!"), F.lit("")).alias("id"),
        unicode_text.words_normalized("t").alias("w"), strings.json_float(F.lit(float("inf"))).alias("inf")).first()
    assert tuple(row) == ("x%20y/%C3%BC~", None, "a", {"v": "l"}, "text is not normalized", "unknown joiner", "segment id is malformed", ["ﬁ"], "Infinity")


def test_words_of_latin_texts_match_the_general_pattern(monkeypatch):
    import random

    rnd = random.Random(5)
    letters = [chr(c) for c in range(32, 0x250)] + list("\n–—‘’“”„") + list(".,;'’_-0123456789abcAB") * 10
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(20_000)]
    fast = [kernels.words(t) for t in texts]
    monkeypatch.setattr(kernels, "_LATIN", re.compile("(?!)"))
    assert [kernels.words(t) for t in texts] == fast
    assert all(kernels.graphemes(t) == kernels._CLUSTER.findall(t) for t in texts)


def test_counts_of_the_corpus_against_brute_force(spark, tiny):
    want = Counter()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        tokens = (r.text or "").replace("\n", " ").split(" ")
        for k in range(0, len(tokens), 12):
            gt = " ".join(tokens[k : k + 12])
            ocr = recognised(gt, r.doc_id + k // 12)
            for level, cut in (("character_level", kernels.graphemes), ("word_level", kernels.words)):
                want.update((level, *p) for p in kernels.align(cut(kernels.nfc(gt)), cut(kernels.nfc(ocr))) if p[0] != p[1])
    got = {(r.level, r.gt, r.ocr): r.n for r in registry.QUERIES["diff_counts_corpus"](spark, tiny).collect()}
    assert got == dict(want)
    kept = {r.level: r.kept for r in registry.QUERIES["threshold_diffs_documents"](spark, tiny).collect()}
    assert kept == Counter(level for (level, _, _), n in want.items() if n >= 3)


def test_segments_of_every_difference(spark, tiny):
    groups = {}
    for r in registry.QUERIES["segment_id_at_pos_documents"](spark, tiny).collect():
        groups.setdefault((r.doc_id, r.line_no), []).append(r)
    lines = {}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        tokens = (r.text or "").replace("\n", " ").split(" ")
        for k in range(0, len(tokens), 12):
            lines[r.doc_id, k // 12] = tokens[k : k + 12]
    for (doc, no), found in groups.items():
        words = lines[doc, no]
        gt = " ".join(words)
        ids, at = [None] * len(gt), 0
        for nth in range(0, len(words), 4):
            part = " ".join(words[nth : nth + 4])
            ids[at : at + len(part)] = [f"group {nth // 4}"] * len(part)
            at += len(part) + 1
        place, want = 0, {}
        for pos, (g, o) in enumerate(kernels.align(kernels.graphemes(kernels.nfc(gt)), kernels.graphemes(kernels.nfc(recognised(gt, doc + no))))):
            if g != o:
                want[pos] = ids[place] if g is not None else None
            place += len(g or "")
        assert {r.pos: r.gt_segment_id for r in found} == want


def test_html_reports_show_both_texts(spark, tiny):
    texts = {r.item_id: r.text or "" for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    for r in registry.QUERIES["report_html"](spark, tiny).collect():
        blocks = re.findall(r'<div class="gt">(.*?)</div><div class="ocr">(.*?)</div>', r.html, re.S)
        bare = [html.unescape(re.sub("<[^>]+>", "", re.sub(r'<span class="[^"]*ellipsis"[^>]*>.*?</span>', "", b).replace("<br>", "\n"))) for b in blocks[0]]
        assert bare == [texts[r.item_id], recognised(texts[r.item_id], r.item_id)]
        classes = [Counter(re.findall(r"cdiff\d+", b)) for b in blocks[0]]
        assert classes[0] == classes[1] and classes[0]
        assert "<script>" in r.html and "Occurrences" in r.html


def test_tables_of_few_files_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    assert staging.read_table(spark, str(tmp_path / "one")).rdd.getNumPartitions() == cores
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Repartition" not in plan(staging.read_table(spark, str(tmp_path / "many")))
    monkeypatch.setattr(staging, "SMALL_SHARE", 1)
    assert "Repartition" not in plan(staging.read_table(spark, str(tmp_path / "one")))
    assert files.read_files(spark, str(tmp_path / "one"), pattern="*.parquet").count() == 1

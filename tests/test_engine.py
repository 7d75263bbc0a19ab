import json
import math
import random
import xml.etree.ElementTree as ET

import pytest

from inkmeter import api, cli
from inkmeter.functions import distance, kernels, unicode_text
from inkmeter.plans import compare, registry, summarize, workspace
from inkmeter.plans.oracle import same_rows
from inkmeter.sources import files, parse


def matrix(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def test_kernels_against_the_full_matrix():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        d, ops, i, j = matrix(a, b), [], len(a), len(b)
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            elif i and d[i][j] == d[i - 1][j] + 1:
                ops, i = [("delete", i - 1, j), *ops], i - 1
            elif j and d[i][j] == d[i][j - 1] + 1:
                ops, j = [("insert", i, j - 1), *ops], j - 1
            else:
                ops, i, j = [("replace", i - 1, j - 1), *ops], i - 1, j - 1
        assert kernels.edit_script(a, b) == ops and kernels.distance(a, b) == d[-1][-1] == len(ops)


def test_values():
    assert api.distance("Fnord", "Food") == 2 and api.distance("Schlyñ", "Schlyñ") == 0 and api.distance("Schlyñ", "Schlym̃") == 1
    assert api.editops("Schlyñ", "Schlym̃") == [("replace", 5, 5)]
    assert api.character_error_rate("", "x") == math.inf and api.character_error_rate("", "") == 0.0 and api.character_error_rate("Foo", "") == 1.0
    assert api.words("Hallo, Welt! don’t 1.5 –") == ["Hallo", "Welt", "don’t", "1.5"]
    assert api.word_error_rate_n("a b c", "a x") == (2 / 3, 3)
    assert api.score_hint(0.5, 23) == 12 and api.score_hint(math.inf, 12345) is None
    assert api.ExtractedText.from_str("ͤ == ﬁ").text == "Qü – fi"
    t = api.ExtractedText((("a", "xy"), ("b", "z")))
    assert [t.segment_id_for_pos(i) for i in range(5)] == ["a", "a", None, "b", None] and t.text == "xy\nz"


@pytest.mark.parametrize(("index", "conf", "want"), [
    ([], [], None), (["0"], [None], 0), ([None], [".5"], 0), (["1", "0"], [None, None], 1), (["0", None], [".4", ".5"], 0),
    ([None] * 3, [".4", ".5", ".9"], 2), (["0", None], [None, None], 0), ([None, None], [None, ".4"], 1), ([None, None], [None, None], 0)])
def test_text_alternatives(index, conf, want):
    number = lambda x: math.nan if x is None else float(x)
    assert parse.choose_equiv([number(x) for x in index], [number(x) for x in conf]) == want


def test_formats_and_encodings():
    page = '<PcGts xmlns="ns"><Page><ReadingOrder><OrderedGroup><RegionRefIndexed index="2" regionRef="a"/><RegionRefIndexed index="1" regionRef="b"/><RegionRefIndexed index="3" regionRef="gone"/></OrderedGroup></ReadingOrder>' + "".join(
        f'<TextRegion id="{i}"><TextLine id="{i}1"><TextEquiv><Unicode>line {i}</Unicode></TextEquiv></TextLine><TextEquiv><Unicode>{i}</Unicode></TextEquiv></TextRegion>' for i in "abc") + "</Page></PcGts>"
    assert [t for _, _, t in parse.extract(page.encode())[1]] == ["b", "a"]
    assert [t for _, _, t in parse.extract(page.encode(), "line")[1]] == ["line b", "line a"]
    alto = '<alto xmlns="x"><TextLine ID="l"><String CONTENT="a"/><SP/><String CONTENT="b"/></TextLine><TextLine ID="m"/></alto>'
    assert parse.extract(alto.encode()) == ("alto", [(None, "l", "a b"), (None, "m", "")])
    with pytest.raises(ValueError):
        parse.extract(b"<html/>")
    assert api.alto_namespace(ET.fromstring(alto)) == "x"
    assert parse.extract("﻿ a \r\nb\n".encode("utf-8"))[1] == [(None, "line 0", "a"), (None, "line 1", "b")]
    assert [parse.detect_encoding(x) for x in ("ü".encode(), "ü".encode("cp1252"), b"\x81", "a".encode("utf-16"))] == ["utf-8", "cp1252", "latin-1", "utf-16"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, tiny, name):
    assert same_rows(registry.QUERIES[name](spark, tiny), registry.ORACLE_SQL[name], tiny)


def test_queries_without_oracle(spark, tiny):
    for r in registry.QUERIES["report_json"](spark, tiny).collect():
        report = json.loads(r.json)
        assert {"gt", "ocr", "cer", "wer", "differences", "n_characters", "n_words"} == set(report)
    assert all("<table>" in r.html for r in registry.QUERIES["report_html"](spark, tiny).collect())
    counts = {}
    for r in registry.QUERIES["align_lines"](spark, tiny).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert len(counts) == spark.read.parquet(f"{tiny}/documents.parquet").count()


def test_files_folders_and_summary(spark, tmp_path):
    gt, ocr, out = tmp_path / "gt", tmp_path / "ocr", tmp_path / "out"
    for d in (gt, ocr):
        d.mkdir()
    (gt / "1.txt").write_text("This is a test.")
    (ocr / "1.txt").write_text("Tis is a tst.")
    (gt / "2.txt").write_text("only here")
    cli.main(["compare", str(gt), str(ocr), "report", str(out), "--differences"], spark)
    report = json.loads((out / "1.txt-report.json").read_text())
    assert report["cer"] == 2 / 15 and report["n_words"] == 4 and report["differences"]["character_level"] == {"h :: None": 1, "e :: None": 1}
    assert "diff" in (out / "1.txt-report.html").read_text()
    (out / "bad.json").write_text('{"cer": Infinity}')
    found = summarize.summarize(spark, str(out)).first()
    assert found.num_reports == 1 and json.loads((out / "summary.json").read_text())["differences"]["word_level"]
    assert summarize.summarize(spark, str(gt)) is None
    compare.compare_files(spark, str(gt / "1.txt"), str(gt / "1.txt"), "same", str(out), metrics=False)
    assert "cer" not in json.loads((out / "same.json").read_text())


def test_line_dirs(spark, tmp_path):
    for n, (g, o) in {"a": ("This is a test.", "Tis is a test."), "b": ("Another test.", "AnÖther test.")}.items():
        (tmp_path / f"{n}.gt.txt").write_text(g)
        (tmp_path / f"{n}.some-ocr.txt").write_text(o)
    total = compare.compare_line_dirs(spark, str(tmp_path), str(tmp_path), str(tmp_path / "report"), gt_suffix=".gt.txt", ocr_suffix=".some-ocr.txt").first()
    assert total.cer == 2 / 28 and total.wer == 2 / 6
    with pytest.raises(Exception, match="no file for"):
        (tmp_path / "c.gt.txt").write_text("x")
        compare.compare_line_dirs(spark, str(tmp_path), str(tmp_path), str(tmp_path / "r2"), gt_suffix=".gt.txt", ocr_suffix=".some-ocr.txt")
    assert files.read_files(spark, str(tmp_path), recursive=True).count() >= 5


def test_workspace(spark, tmp_path):
    for group, text in (("GT", "abc"), ("OCR", "abd")):
        (tmp_path / group).mkdir()
        (tmp_path / group / "1.txt").write_text(text)
    (tmp_path / "mets.xml").write_text(
        '<m:mets xmlns:m="http://www.loc.gov/METS/" xmlns:x="http://www.w3.org/1999/xlink"><m:fileSec>'
        + "".join(f'<m:fileGrp USE="{g}"><m:file ID="{g}1" MIMETYPE="text/plain"><m:FLocat x:href="{g}/1.txt"/></m:file></m:fileGrp>' for g in ("GT", "OCR"))
        + '</m:fileSec><m:structMap><m:div TYPE="physSequence"><m:div TYPE="page" ID="P1"><m:fptr FILEID="GT1"/><m:fptr FILEID="OCR1"/></m:div></m:div></m:structMap></m:mets>')
    mets = str(tmp_path / "mets.xml")
    assert workspace.evaluate(spark, mets, "GT", "OCR", "EVAL").count() == 2
    assert json.loads((tmp_path / "EVAL" / "EVAL_P1.json").read_text())["cer"] == 1 / 3
    assert sum(r[2] == "EVAL" for r in parse.mets_files((tmp_path / "mets.xml").read_bytes())) == 2
    with pytest.raises(FileExistsError):
        workspace.evaluate(spark, mets, "GT", "OCR", "EVAL")
    workspace.evaluate(spark, mets, "GT", "OCR", "EVAL", overwrite=True)


def test_functions_in_sql(spark):
    distance.register(spark)
    unicode_text.register(spark)
    row = spark.sql("SELECT seq_distance(array('a', 'b'), array('a', 'c', 'd')) AS d, seq_align(array('a'), array('b'))[0].ocr AS o, seq_editops(array('a'), array())[0].op AS e, nfc('u\u0308') AS c, unicode_words('a, b')[1] AS w").first()
    assert tuple(row) == (2, "b", "delete", "ü", "b")


def test_streamed_summary(spark, tmp_path):
    from inkmeter.streaming import summary as stream

    folder = tmp_path / "reports"
    folder.mkdir()
    for i, (c, w) in enumerate([(0.05, 0.15), (0.10, 0.20)]):
        (folder / f"{i}.json").write_text(json.dumps({"cer": c, "wer": w, "differences": {"character_level": {"a :: b": 10}, "word_level": {}}}))
    reports = stream.stream_reports(spark, str(folder))
    stream.start(stream.running_rates(reports), "rates_now", str(tmp_path / "ck")).awaitTermination(60)
    stream.start(stream.running_differences(reports), "differences_now", str(tmp_path / "ck2")).awaitTermination(60)
    assert [tuple(r) for r in spark.table("differences_now").collect()] == [("character_level", "a :: b", 20)]
    row = spark.table("rates_now").first()
    assert row.num_reports == 2 and abs(row.cer_avg - 0.075) < 1e-9

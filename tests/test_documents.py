import json
from collections import Counter

from inkmeter.plans import registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def recognised(text, number):
    for old, new in (("rn", "m"), ("e", "c"), ("th", "t"), ("an", "aan"), (", ", " ")):
        text = text.replace(old, new)
    return text + ("ß" if number % 3 == 0 else "")


def test_every_document_against_brute_force(spark, tmp_path):
    texts = {1: "the corn, an early one\nand then more of it " * 40, 2: "", 3: None, 4: "short"}
    spark.createDataFrame([(d, t, "en", "s") for d, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = {}
    for d, t in texts.items():
        words = (t or "").replace("\n", " ").split(" ")
        for k in range(0, len(words), 12):
            gt = " ".join(words[k : k + 12])
            lines[d, k // 12] = (gt, recognised(gt, d + k // 12))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    want = {at: distance(*pair) for at, pair in lines.items()}
    scripts = Counter((r.doc_id, r.line_no) for r in run("editops_documents"))
    assert {at: n for at, n in want.items() if n} == dict(scripts)
    rows = {}
    for r in sorted(run("align_chars_documents"), key=lambda r: r.pos):
        rows.setdefault((r.doc_id, r.line_no), []).append((r.gt, r.ocr))
    for at, (gt, ocr) in lines.items():
        found = rows.get(at, [])
        assert "".join(g or "" for g, _ in found) == gt and "".join(o or "" for _, o in found) == ocr and sum(g != o for g, o in found) == want[at]
    merged = sum(r.n for r in run("merge_diff_maps_documents") if r.level == "character_level")
    assert merged == sum(want.values()) and run("summary_documents")[0].num_reports == len(texts)
    assert {r.doc_id for r in run("align_words_documents")} >= {1, 4}
    reports = {r.doc_id: json.loads(r.json) for r in run("report_json_documents")}
    for d in texts:
        assert sum(reports[d]["differences"]["character_level"].values()) == sum(n for at, n in want.items() if at[0] == d)
    assert {r.doc_id for r in run("report_html_documents")} == set(texts)

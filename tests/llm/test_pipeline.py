


import corpus_pipeline
from inkmeter.llm import secrets
from tests.llm.helpers import CLASHES, DOCS, awkward, docs


def test_stages_end_to_end(spark, tiny):
    docs_in = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = [docs_in]
    for _, step in corpus_pipeline.STAGES:
        kept.append(step(spark, kept[-1], tiny))
    for df in kept[:-1]:
        assert df.columns == docs_in.columns
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in kept]
    texts = {r.doc_id: r.text for r in docs_in.collect()}
    # language ID keeps what has a letter
    assert set(ids[1]) == {d for d, t in texts.items() if any(map(str.isalpha, t or ""))}
    # one of each group of equal texts stays, and every group of the operator is represented
    assert len({texts[d] for d in ids[2]}) == len(ids[2]) and set(ids[2]) <= set(ids[1])
    # the scan drops nothing, mixing keeps every document, packing returns all of them
    assert sorted(ids[3]) == sorted(ids[2]) and set(ids[4]) == set(ids[3]) and set(ids[5]) == set(ids[4])
    final = sorted(tuple(r) for r in kept[-1].select("doc_id", "length", "doc_tokens").collect())
    assert final == sorted(tuple(r) for r in corpus_pipeline.run(spark, tiny).select("doc_id", "length", "doc_tokens").collect())


def test_awkward_table_runs_through(spark, tiny):
    df = awkward(spark, extra=False)
    for _, step in corpus_pipeline.STAGES[:-1]:
        df = step(spark, df, tiny)
        assert df.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, df, tiny).count() > 0
    empty = docs(spark, [])
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, tiny)
        assert empty.count() == 0


def test_clashing_columns_come_back_unchanged(spark, tiny):
    rows = [(1, "The cat sat on the mat and said password = hunter2hunter2 to no one"), (2, "The cat sat on the mat and said nothing at all"), (3, "12345")] * 2
    df = docs(spark, rows, extra=True)
    for _, step in corpus_pipeline.STAGES[:-1]:
        df = step(spark, df, tiny)
        assert df.columns == [*[c.split()[0] for c in DOCS.split(", ")], *CLASHES]
    out = df.collect()
    assert {r.doc_id for r in out} == {1, 2} and all(r[c] == "junk" for r in out for c in CLASHES)


def test_decisions_take_effect(spark, tiny):
    secret = "password = hunter2hunter2"
    rows = [(1, f"The cat sat on the mat and said {secret} to no one at all"), (2, "12345 !!"), (3, None), (4, "Another text about the house and the garden")]
    df = docs(spark, rows)
    df = corpus_pipeline.identify_language(spark, df, tiny)
    assert sorted(r.doc_id for r in df.collect()) == [1, 4]
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, df, tiny).collect()}
    assert secret not in masked[1] and secrets.MASK in masked[1] and masked[4] == rows[3][1]

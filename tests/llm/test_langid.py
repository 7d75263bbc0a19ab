import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkmeter.llm import langid
from tests.llm.helpers import awkward, docs


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = langid.op8_langid(spark, small).collect()
    assert len(out) == len(truth)
    right = total = 0
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and truth[r.doc_id].lang and any(map(str.isalpha, truth[r.doc_id].text or "")):
            total += 1
            right += r.lang_pred == truth[r.doc_id].lang
    assert total > 100 and right / total >= 0.95


def test_held_out_labels_and_other_columns_never_matter(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    own = langid.held_out()
    twisted = df.withColumns({"lang": F.when(own, F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("one"), "n_chars": F.lit(0)})
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit_on_training_rows(df)).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(twisted, langid.fit_on_training_rows(twisted)).collect()}
    assert one == two


def test_awkward_rows(spark, tiny):
    model = langid.fit_on_training_rows(spark.read.parquet(f"{tiny}/documents.parquet"))
    df = awkward(spark).withColumn("lang_pred", F.lit("old"))
    out = langid.predict(df, model).collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and by[1].score == 0
    assert by[5].lang_pred == "en" and by[4].lang_pred in model.langs
    assert langid.predict(docs(spark, []), model).count() == 0
    assert "key" in langid.predict(df, model).columns


def test_models_of_few_classes(spark):
    none = langid.fit_on_training_rows(docs(spark, []))
    assert [r.lang_pred for r in langid.predict(docs(spark, [(1, "text")]), none).collect()] == ["und"]
    one = langid.fit_on_training_rows(docs(spark, [(i, "some words") for i in range(20)]))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs(spark, [(1, "text")]), one).collect()] == [("en", 1.0)]


def test_codes_tell_all_classes_apart():
    for n in range(2, 40):
        code = langid.code_matrix(n)
        assert code.shape[0] == n
        for a in range(n):
            for b in range(a):
                assert (code[a] != code[b]).sum() >= min(2, code.shape[1])


def grams_of(text):
    """Hashed counts of the folded text's byte 1-, 2- and 3-grams, gram by gram."""
    octets = [c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode(errors="replace")]
    found = Counter()
    for order in (1, 2, 3):
        for i in range(len(octets) - order + 1):
            gram = octets[i : i + order]
            if gram[0] == 32 and (order == 1 or gram[1] == 32):
                continue
            code = order
            for c in gram:
                code = code * 257 + c
            found[((code * 0x9E3779B1) >> 7) % langid.N_FEATURES] += 1
    return found


def test_codes_and_decoding_against_a_plain_version(spark, tiny):
    """Counts, binary classifiers, margins and loss-weighted decoding of the whole table, recomputed one number at a time."""
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    model = langid.fit_on_training_rows(df)
    counts = defaultdict(Counter)
    for d, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            counts[lang].update(grams_of(t))
    langs = sorted(counts)
    assert langs == model.langs
    n, size = len(langs), langid.N_FEATURES
    bits = [[1] + [1 if c >> k & 1 else -1 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]  # one row a bit
    total = [sum(counts[x].values()) for x in langs]
    share = [[(counts[x][f] + 0.5) / (total[i] + 0.5 * size) for f in range(size)] for i, x in enumerate(langs)]
    weights = []
    for bit in bits:
        on, off = [i for i in range(n) if bit[i] > 0], [i for i in range(n) if bit[i] < 0]
        weights.append([math.log(sum(share[i][f] for i in on) / len(on)) - math.log(sum(share[i][f] for i in off) / len(off)) for f in range(size)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    for d, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert got[d] == ("und", 0.0)
            continue
        own = grams_of(t)
        loss = [0.0] * n
        for b, bit in enumerate(bits):
            margin = sum(c * weights[b][f] for f, c in own.items()) / max(1, sum(own.values()))
            z = max(-20.0, min(20.0, (margin - model.shift[b]) * model.scale[b]))
            for i in range(n):
                loss[i] += model.weight[b] * math.log1p(math.exp(-bit[i] * z))
        order = sorted(range(n), key=lambda i: loss[i])
        assert abs(got[d][1] - math.tanh(2 * (loss[order[1]] - loss[order[0]]))) < 1e-4
        assert got[d][0] == langs[order[0]] or loss[order[1]] - loss[order[0]] < 1e-4


def test_the_model_does_not_depend_on_the_layout(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    one, two = (langid.fit_on_training_rows(x) for x in (df, df.orderBy("text").repartition(7)))
    assert (one.shift == two.shift).all() and (one.scale == two.scale).all() and (one.weight == two.weight).all()

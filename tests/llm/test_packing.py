import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkmeter.llm import packing
from tests.llm.helpers import awkward, docs


def direct_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(rows, out, most=2048):
    """Every id of every row lies in one piece, in place; gives the padding over all sequences."""
    want = {}
    for (doc, _), ids in zip(rows, direct_ids([t for _, t in rows]), strict=True):
        want.setdefault((doc, len(ids)), []).append(ids)
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for key, copies in want.items():
        found = sorted(pieces[key])
        assert sum(n for _, n, _ in found) == len(copies) * key[1]
        for start, n, crc in found:
            assert any(zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc for ids in copies)
        if len(copies) == 1:
            assert [s for s, _, _ in found] == list(np.cumsum([0, *(n for _, n, _ in found)])[:-1])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


def test_driver_table_ids_and_padding(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    padding = check(rows, packing.op7_packing(spark, small).collect())
    total = sum(map(len, direct_ids([t for _, t in rows])))
    assert padding < 0.01 * total


def test_awkward_rows(spark):
    df = awkward(spark)
    check([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], packing.pack(df, packing.tokenizer_file()).collect())
    assert packing.pack(docs(spark, []), packing.tokenizer_file()).count() == 0
    (only,) = packing.pack(docs(spark, [(3, None)]), packing.tokenizer_file()).collect()
    assert (only.length, only.doc_tokens, only.offset) == (1, 1, 0)


def test_word_memory_equals_whole_text_encoding():
    words = packing.words_of(packing.tokenizer_file())
    rnd = random.Random(1)
    texts = ["Straße ÉCOLE naïve", "İstanbul ŞİŞ", "a b c", "<|endoftext|> x", "<|ENDOFTEXT|>", "it's don't WE'LL 's", "12ab34 $%^ a..b", "é é", "ﬁ ſ Å", "日本 語", "x\x1cy\x85z",
             "A" * 5000, "‘quoted’ “text” – dash …", "\t\x0b\x0c\r\n", "a\u0000b", "ǅ Ǆ ŉ ǰ", "end. end! end.. l'. a'. it's. x&&& 7. .", "word... word.,;:!?"]
    texts += ["".join(rnd.choice("aAbZ '.,!\n\tÀéß0129-_<|>“”") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for text, ids in zip(texts, direct_ids(texts), strict=True):
        assert list(np.frombuffer(words.ids([text])[0], "<u4")) == ids[:-1], text
    for own, ids in zip(words.ids(texts), direct_ids(texts), strict=True):
        assert list(np.frombuffer(own, "<u4")) == ids[:-1]


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    words = packing.Words(packing.tokenizer_file())
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}." for j in range(9)) for i in range(60)]
    for text, ids in zip(texts, direct_ids(texts), strict=True):
        assert list(np.frombuffer(words.ids([text])[0], "<u4")) == ids[:-1]


def brute_cost(at, penalty, most):
    cost = [0] + [None] * (len(at) - 1)
    for i in range(1, len(at)):
        cost[i] = penalty[i] + min(
            (cost[j] + (0 if (n := at[i] - at[j]) & (n - 1) == 0 else most - n) for j in range(i) if at[i] - at[j] <= most and cost[j] is not None))
    return cost[-1]


def test_programme_is_optimal():
    rnd = random.Random(4)
    for _ in range(150):
        most = rnd.choice([8, 16, 32])
        gaps = [rnd.randint(1, most) for _ in range(rnd.randint(1, 40))]
        at = np.cumsum([0, *gaps])
        penalty = np.array([0, *[rnd.choice([0, 0, 2, 7]) for _ in gaps]])
        cuts = packing.plan_cuts(at, penalty, most)
        assert cuts[-1] == at[-1]
        lengths = np.diff(np.r_[0, cuts])
        assert (lengths <= most).all() and set(cuts.tolist()) <= set(at.tolist())
        cost = sum(0 if n & (n - 1) == 0 else most - n for n in lengths.tolist()) + sum(int(penalty[list(at).index(c)]) for c in cuts)
        assert cost == brute_cost(at.tolist(), penalty.tolist(), most)


def test_order_is_kept(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text")).coalesce(1)
    out = packing.pack(df, packing.tokenizer_file()).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)

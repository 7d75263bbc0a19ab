import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from inkmeter.llm import substrings
from tests.llm.helpers import awkward, docs


def brute(rows, depth=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a set of all windows seen so far."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            w = data[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in substrings.remove_repeats(df).collect())


def test_driver_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in substrings.op6_substrings(spark, small).collect()) == brute(rows)


def passed(rows, hot):
    """The passes in this process, in batches of a few rows: documents' intervals, as ``repeated_spans`` has them."""

    def dealt(found, *by):
        table = pa.Table.from_batches(list(found))
        table = table.sort_by([(c, "ascending") for c in by])
        return table, table.to_batches(max_chunksize=37)

    texts = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], ["doc", "data"])
    anchors, _ = dealt(substrings._anchor_rows([texts], np.zeros(0, np.int64)), "gram", "around", "doc", "at")
    grams = np.unique(anchors["gram"].to_numpy()) if hot else np.zeros(0, np.int64)
    table, batches = dealt(substrings._anchor_rows([texts], grams), "gram", "around", "doc", "at")
    settled = pa.Table.from_batches(list(substrings._settle((b.drop_columns(["deal"]) for b in batches), grams))).to_pylist()
    cuts = [(r["doc"], r["a"], r["b"]) for r in settled if r["kind"] == 0]
    asked = {}
    for r in settled:
        if r["kind"] == 1:
            asked.setdefault(r["doc"], []).append(2 * r["a"] + r["b"])
    data = dict(rows)
    wanted = pa.RecordBatch.from_arrays([
        pa.array(list(asked), pa.int64()), pa.array(list(asked.values()), pa.list_(pa.int64())), pa.array([(data[d] or "").encode() for d in asked], pa.binary())], ["doc", "asked", "data"])
    around, _ = dealt(substrings._surroundings([wanted]), "key", "doc", "meta")
    part = pa.array([x is not None for x in around["deal"].to_pylist()], pa.bool_())
    around = pa.table([around["key"], part, around["doc"], around["meta"], around["rest"]], names=["key", "hot", "doc", "meta", "rest"])
    refined = pa.Table.from_batches(list(substrings._refined(iter(around.to_batches(max_chunksize=37)))))
    cuts += [(r["doc"], r["a"], r["b"]) for r in refined.to_pylist() if r["kind"] == 0]
    firsts = refined.filter(pc.equal(refined["kind"], 1)).select(["key", "hash", "doc", "a", "b"])
    again = substrings._again(iter(firsts.sort_by([(c, "ascending") for c in firsts.column_names]).to_batches(max_chunksize=11)))
    cuts += [(r["doc"], r["a"], r["b"]) for b in again for r in b.to_pylist()]
    out = []
    for d, t in sorted(rows):
        octets = (t or "").encode()
        gone = bytearray(len(octets))
        for doc, a, b in cuts:
            if doc == d:
                gone[a:b] = b"\1" * (b - a)
        out.append((d, bytes(o for o, g in zip(octets, gone, strict=True) if not g)))
    return out, len(firsts)


@pytest.mark.parametrize(("hot", "held"), [(False, 1 << 16), (False, 50), (True, 1 << 16), (True, 20)])
def test_groups_held_in_parts_against_brute_force(monkeypatch, hot, held):
    """A group may be larger than what a task holds, and a hot one is dealt to several: the result is the same."""
    monkeypatch.setattr(substrings, "REFINE_ROWS", held)
    rnd = random.Random(4)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = prose(180)
    rows = [(i, prose(rnd.randint(0, 90)) + common[rnd.randint(0, 30) : rnd.randint(140, 180)] + prose(rnd.randint(0, 90))) for i in range(120)]
    rows += [(200 + i, "ab" * rnd.randint(40, 90) + common) for i in range(20)]
    found, parted = passed(rows, hot)
    assert [(d, len(kept), hashlib.sha256(kept).hexdigest()) for d, kept in found] == [(d, n - gone, sha) for d, n, gone, _, sha in brute(rows)]
    assert (parted > 0) == (hot or held == 50)


def test_a_hot_passage(spark):
    """In every text, between ever different neighbours: its grams are dealt by their surroundings and by document."""
    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = prose(250)
    rows = [(i, prose(rnd.randint(30, 150)) + common[rnd.randint(0, 60) : rnd.randint(170, 250)] + prose(rnd.randint(30, 150))) for i in range(300)]
    df = docs(spark, rows)
    assert len(substrings.hot_grams(substrings._by_document(df, "doc_id", "text")))
    assert got(df) == brute(rows)


def test_planted_passages(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))[:n]
    passages = [prose(n) for n in (99, 100, 101, 130, 168, 169, 300, 1000)]
    rows = []
    for i in range(220):
        parts = [prose(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, max(0, len(p) - 90))
            parts += [p[a : a + rnd.randint(90, len(p))], prose(rnd.randint(0, 60))]
        rows.append((i, "".join(parts)))
    assert got(docs(spark, rows, True)) == brute(rows)


def test_periodic_and_low_entropy_texts(spark):
    rnd = random.Random(8)
    rows = [(1, "a" * 500), (2, "ab" * 400), (3, "a" * 99), (4, "b" + "a" * 100), (5, "abc" * 200 + "x" + "abc" * 200), (6, "a" * 100), (7, "ü" * 120),
            (8, "".join(rnd.choice("ab") for _ in range(4000))), (9, "\n" * 250), (10, "x".join("line of a log " * 3 for _ in range(40)))]
    rows.append((11, rows[7][1][500:2500] + "tail"))
    assert got(docs(spark, rows)) == brute(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = substrings.remove_repeats(df).collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[6].n_removed == by[6].n_bytes and by[6].n_spans == 1 and by[1].n_bytes == 0 and 0 < by[5].n_removed < by[5].n_bytes
    assert all(r.n_removed == 0 for r in out if r.doc_id is None)
    assert substrings.remove_repeats(docs(spark, [])).count() == 0

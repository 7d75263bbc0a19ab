import random
import re

import numpy as np
import xxhash

from inkmeter.llm import graph, simhash
from tests.llm.helpers import awkward, docs


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < shingle else [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, most=3):
    """fps: [(id, fp)] -> [(id, fp, smallest reachable id)]"""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, f, least[find(i)]) for i, (d, f) in enumerate(fps))


def got(df):
    return sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect())


def test_fingerprint():
    for text in ("", None, " \t", "One", "a B", "a b c", "a b c d e f g a b c", "ÄÖ x\x1fy z w q   r", "w " * 70_000):
        assert simhash.fingerprint((text or "").encode()) == plain(text)


def test_whole_table_against_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    out = simhash.op2_simhash(spark, tiny).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out) == brute([(d, plain(t)) for d, t in rows])


def test_links_of_planted_fingerprints(spark):
    rnd = random.Random(5)
    fps = {0, 2**64 - 1}
    for size in (1, 2, 5, 400):  # the last fills an anchor beyond the direct limit
        base = rnd.getrandbits(64)
        fps |= {base}
        for _ in range(size):
            x = base
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in graph.components(pairs).collect()}
    want = brute([(s[0], f) for s, f in zip(signed, fps, strict=True)])
    have = {}
    for (s,) in signed:
        have.setdefault(roots.get(s, s), []).append(s)
    groups = {}
    for d, _, c in want:
        groups.setdefault(c, []).append(d)
    assert sorted(sorted(g) for g in have.values()) == sorted(sorted(g) for g in groups.values())


def test_awkward_rows(spark):
    df = awkward(spark)
    out = simhash.near_duplicates(df).collect()
    assert len(out) == df.count()
    of = {r.doc_id: r for r in out}
    assert of[1].component_id == of[2].component_id == of[3].component_id == 1 and of[1].fp == 0
    assert of[5].component_id == of[6].component_id == 5 and of[4].component_id == 4
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 5 in ids and 6 not in ids and len(ids) == len(set(ids)) and {4, 7, 8, 9} <= set(ids)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_forest_keeps_components():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 300, 200), rnd.integers(0, 300, 200)
    r, m = graph.forest(a, b)
    assert len(r) <= 300
    left = brute([(i, 0) for i in range(0)])
    assert left == []

    def parts(u, v):
        root = list(range(300))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            p, q = sorted((find(x), find(y)))
            root[q] = p
        return [find(i) for i in range(300)]

    assert parts(a, b) == parts(r, m)

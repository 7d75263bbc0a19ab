import random
import re

import numpy as np

from inkmeter.llm import graph, nearcopies, simhash
from tests.llm.helpers import docs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a or b else True


def kept(rows):
    """Ids that stay where only similarity 0.8 links: the smallest of every component."""
    sets, root = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({min(d for k, (d, _) in enumerate(rows) if find(k) == find(i)) for i in range(len(rows))})


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"z{rnd.randrange(10**9)}"
    return words


def planted():
    """Pairs on both sides of 0.8, a common line in all, and a group beyond the direct limit."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    line = [word() for _ in range(12)]
    texts = []
    for n in (6, 20, 60, 200, 900):
        for _ in range(8):
            base = [word() for _ in range(n)] + line
            texts += [base, *[edited(rnd, base, rnd.randint(0, max(1, n // 25))) for _ in range(3)]]
    base = [word() for _ in range(150)]
    texts += [edited(rnd, base, rnd.randint(0, 3)) for _ in range(150)]
    texts += [line, line[:4], line[:4], [], []]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_planted_near_copies_against_brute_force(spark):
    rows = planted()
    want = kept(rows)
    assert len(want) < len(rows) - 200
    # 0 bits: equal fingerprints alone, so that similarity decides
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows), most=0).collect()) == want


def test_driver_table_against_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    out = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    sets = {d: plain(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert all(out[a] == out[b] for a, b in pairs)
    assert sum(dict(rows)[a] != dict(rows)[b] for a, b in pairs) >= 2


def test_repeated_ids_are_judged_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    far, near = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(1, far), (1, "a clean text that stands alone under the same number"), (2, near), (3, "one more"), (3, "one more"), (None, far)]
    got = sorted(((r.doc_id or 0), r.text) for r in simhash.keep_one(docs(spark, rows)).collect())
    assert got == sorted([(0, far), (1, far), (1, rows[1][1]), (3, "one more")])


def test_parities_never_rule_out_a_near_copy():
    rnd = random.Random(3)
    for n in (1, 5, 90, 700, 3000):
        a = {rnd.getrandbits(64) for _ in range(n)}
        for drop in (0, n // 20, n // 10):
            b = set(list(a)[drop:]) | {rnd.getrandbits(64) for _ in range(drop)}
            x, y = (np.sort(np.array(sorted(s), np.uint64)) for s in (a, b))
            if alike(a, b):
                assert nearcopies.may_be_alike(len(a), nearcopies.parities(x), len(b), nearcopies.parities(y))
    a, b = ({rnd.getrandbits(64) for _ in range(3000)} for _ in range(2))
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert not nearcopies.may_be_alike(3000, nearcopies.parities(x), 3000, nearcopies.parities(y))


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    rows = planted()
    want = kept(rows)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    monkeypatch.setattr(nearcopies, "ROUNDS", 0)
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows), most=0).collect()) == want


def test_blocks_pass_on_fewer_links_than_texts_meet(spark):
    rnd = random.Random(5)
    bits = nearcopies.parities(np.array(sorted(rnd.getrandbits(64) for _ in range(100)), np.uint64))
    rows = [(h, key, 100, 0, key, bytearray(bits)) for h in range(20) for key in range(200)]
    met = spark.createDataFrame(rows, "h long, key long, n long, pos long, label long, bits binary")
    pairs = nearcopies._block_pairs(met)
    assert pairs.count() <= 199 * 4  # tasks; every pair would be 19,900
    roots = graph.components(pairs).collect()
    assert len(roots) == 199 and {r.root for r in roots} == {0}


def borderline():
    """Families whose pairs lie closely on both sides of 0.8, so that parities leave most of them."""
    rnd = random.Random(9)
    texts = []
    for n in (300, 300, 400, 1500):
        base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        texts += [edited(rnd, base, n // rnd.choice((80, 70, 60))) for _ in range(40)]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_blocks_of_a_large_cluster_meet(spark, monkeypatch):
    rows = borderline()
    want = kept(rows)
    assert 40 < len(want) < len(rows) - 40
    monkeypatch.setattr(nearcopies, "ROUNDS", 0)
    for block, sets in ((8, 2_000), (nearcopies.BLOCK, nearcopies.SET_BLOCK)):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        monkeypatch.setattr(nearcopies, "SET_BLOCK", sets)
        assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows), most=0).collect()) == want

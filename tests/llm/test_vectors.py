import numpy as np
import pytest

from inkmeter.llm import ann, topk

VECS = "vec_id long, embedding array<double>, shard string, block string, cell string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s", "b", "c", "v") for i, v in rows], VECS)


def numbers(seed, n, dims, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, dims)) * 3
    return [(i, (centres[i % 8] + spread * rnd.normal(size=dims)).tolist()) for i in range(n)]


def brute_cosine(rows, k=5):
    out = []
    for q, x in rows:
        if q % 50:
            continue
        found = sorted((-ann.cosine(np.array(x), np.array(y)), i) for i, y in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def brute_product(rows, k=5):
    ints = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    out = []
    for q in ints:
        if q % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in ints if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_exact_with_factor_one(spark):
    rows = numbers(1, 900, 12)
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # ties: copies of one vector, 20 queries among them
    got = sorted(tuple(r) for r in ann.nearest(table(spark, rows), relax=1.0, shard_rows=100).collect())
    want = brute_cosine(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_recall_with_the_production_factor(spark, small):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in ann.op3_ann(spark, small).collect()}
    want = {(q, i) for q, _, i, _ in brute_cosine(rows)}
    assert len(got & want) / len(want) >= 0.9


def test_recall_in_many_shards(spark):
    rows = numbers(3, 3000, 16, spread=2.0)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table(spark, rows), shard_rows=200).collect()}
    want = {(q, i) for q, _, i, _ in brute_cosine(rows)}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("find", [ann.nearest, topk.top_k])
def test_awkward_vectors(spark, find):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [float("nan"), 1.0]), (150, [0.0, 0.0]), (200, []), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [1.0, None]), (3, [float("inf"), 0.0]), (1, [2.0, 0.0])]
    got = sorted(tuple(r) for r in find(table(spark, rows)).collect())
    if find is ann.nearest:
        assert got == [(0, 1, 1, 1.0)]  # zero vectors take no part; the repeated row counts once
    else:
        assert got == [(0, 1, 1, 256 * 512), (0, 2, 150, 0), (150, 1, 0, 0), (150, 2, 1, 0)]
    assert find(table(spark, [])).count() == 0
    assert find(table(spark, [(0, [1.0])])).count() == 0


def test_products_against_brute_force(spark):
    rows = [(i, [x * (1 + 10 * (i % 97 == 0)) for x in v]) for i, v in numbers(4, 1200, 10)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]
    got = sorted(tuple(r) for r in topk.top_k(table(spark, rows), block_rows=128).collect())
    assert got == brute_product(rows)


def test_products_of_large_components(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (2, [2.0**21, 3.0]), (3, [2.0**23, 0.0])]
    got = [tuple(r) for r in topk.top_k(table(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2305843009213693952), (0, 2, 1, got[1][3]), (0, 3, 2, got[2][3])] and got == brute_product(rows)
    rnd = np.random.default_rng(6)
    # sums beyond 2^53, bounds about 2^62, and components of 2^30 and more against small queries
    for top, least in ((19, 19), (22.4, 22.4), (38, 6), (60, -20)):
        wide = [(i, (rnd.choice([-1, 1], 3) * 2.0 ** rnd.uniform(0, 1, 3) * 2.0 ** (least if i % 50 == 0 else top)).tolist()) for i in range(1, 301)]
        wide += [(0, [2.0**least, 2.0**least, 0.0])]
        wide = [(i, v) for i, v in wide if i == 0 or i % 50]  # one query: two of them would meet beyond a long
        assert sorted(tuple(r) for r in topk.top_k(table(spark, wide), block_rows=50).collect()) == brute_product(wide)


@pytest.mark.parametrize("other", [[2.0**40, 1.0], [2.0**600, 1.0]])
def test_scores_that_fit_no_long_raise(spark, other):
    with pytest.raises(Exception, match="does not fit in a long|2\\^500"):
        topk.top_k(table(spark, [(0, [2.0**30, 1.0]), (1, other)])).collect()


def test_a_vector_that_most_rows_share(spark):
    rows = numbers(9, 300, 6)
    rows += [(5000 + i, rows[0][1]) for i in range(500)]
    assert [g[:3] for g in sorted(tuple(r) for r in ann.nearest(table(spark, rows), relax=1.0, shard_rows=40).collect())] == [w[:3] for w in brute_cosine(rows)]
    assert sorted(tuple(r) for r in topk.top_k(table(spark, rows), block_rows=40).collect()) == brute_product(rows)


def test_vectors_of_differing_length(spark):
    rows = [(i, v[: 2 + i % 5]) for i, v in numbers(11, 200, 6)]
    padded = [(i, v + [0.0] * (6 - len(v))) for i, v in rows]
    assert [g[:3] for g in sorted(tuple(r) for r in ann.nearest(table(spark, rows), relax=1.0, shard_rows=30).collect())] == [w[:3] for w in brute_cosine(padded)]
    assert sorted(tuple(r) for r in topk.top_k(table(spark, rows), block_rows=30).collect()) == brute_product(padded)


def test_products_on_the_driver_table(spark, tiny):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op10_topk(spark, tiny).collect()) == brute_product(rows)

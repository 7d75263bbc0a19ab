import math
import re
from collections import Counter, defaultdict

import pytest

from inkmeter.llm import mixing
from tests.llm.helpers import awkward, docs


def allocation(rows, budget_share, target_entropy, max_repeats):
    """Per source: tokens, weight and the tokens to spend, by plain bisection on the exponent."""
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += len(re.findall(r"\S+", t))
    some, whole = {s: n for s, n in totals.items() if n}, sum(totals.values())

    def weights(a):
        w = {s: (n / whole) ** a for s, n in some.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def epochs(a):
        w = weights(a)
        e = [w[s] / n for s, n in some.items()]
        return max(e) / min(e) if budget_share is None else max(e) * budget_share * whole

    def least(value, target):
        low, high = 0.0, 1.0
        if value(low) <= target:
            return low
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if value(mid) <= target else (mid, high)
        return high

    a = max(least(lambda x: entropy(weights(x).values()), target_entropy * math.log(len(some))), least(epochs, max_repeats))
    w = weights(a)
    budget = max(n / w[s] for s, n in some.items()) if budget_share is None else budget_share * whole
    return totals, w, {s: w[s] * budget for s in some}


@pytest.mark.parametrize("share", [1.0, 2.5, None])
def test_the_driver_table_against_a_recomputed_allocation(spark, small, share):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang, r.source or "") for r in table.collect()]
    out = mixing.op4_mixing(spark, small) if share == 1.0 else mixing.copies(table, budget_share=share).selectExpr("doc_id", "coalesce(source, '') AS source", "_tokens AS tokens", "_weight AS weight", "_copies AS copies")
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, *_ in rows)
    own = {d: (len(re.findall(r"\S+", t)), s) for d, t, _, s in rows}
    assert all((r.tokens, r.source) == own[r.doc_id] for r in got)
    totals, weight, wanted = allocation(rows, share, mixing.TARGET_ENTROPY, mixing.MAX_REPEATS)
    for source in totals:
        mine = [r for r in got if r.source == source]
        assert all(abs(r.weight - weight.get(source, 0.0)) < 1e-6 for r in mine)
        spent, want = sum(r.tokens * r.copies for r in mine), wanted.get(source, 0.0)
        low, high = min(r.copies for r in mine), max(r.copies for r in mine)
        # whole epochs, and of the next one the documents that the rest of the budget holds: one more would exceed it
        assert high - low <= 1 and low == max(1 if share is None else 0, math.floor(want / totals[source] + 1e-6))
        assert spent <= max(want, totals[source] if share is None else 0) + 1e-3 * want + 1
        left_out = [r.tokens for r in mine if r.copies == low]
        assert high == low or want - spent <= max(left_out) + 1e-3 * want + 1


def corpus(n=3000):
    return [(i, "w " * (1 + i % 17), "en", "hot" if i % 3 == 0 else f"s{int(math.sqrt(i % 400))}") for i in range(n)]


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p > 0)


def test_exponent_meets_the_entropy(spark):
    totals = Counter()
    for _, t, _, s in corpus():
        totals[s] += len(t.split())
    df = spark.createDataFrame(list(totals.items()), "source string, tokens long")
    mix = mixing.solve(df, None, 0.97, None)
    whole = sum(totals.values())

    def at(a):
        w = [(n / whole) ** a for n in totals.values()]
        return entropy([x / sum(w) for x in w])

    assert abs(at(mix.exponent) - 0.97 * math.log(len(totals))) < 1e-6 and 0 < mix.exponent < 1
    uniform = mixing.solve(df, None, 1.0, None)
    assert uniform.exponent == 0.0
    capped = mixing.solve(df, float(whole), None, 2.0)
    w = {s: (n / whole) ** capped.exponent for s, n in totals.items()}
    assert max(w[s] / sum(w.values()) * whole / totals[s] for s in totals) <= 2.0 + 1e-6


def test_budgets_are_spent(spark):
    rows = corpus()
    out = mixing.copies(docs(spark, rows, True), block_rows=64).collect()
    assert len(out) == len(rows)
    spent, weight, size, longest = Counter(), {}, Counter(), defaultdict(int)
    for r in out:
        spent[r.source] += r._copies * r._tokens
        size[r.source] += r._tokens
        weight[r.source] = r._weight
        longest[r.source] = max(longest[r.source], r._tokens)
    whole = sum(size.values())
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in size:
        assert weight[s] * whole - longest[s] - 1 <= spent[s] <= weight[s] * whole + 1
        each = {r._copies for r in out if r.source == s}
        assert max(each) - min(each) <= 1
    again = mixing.copies(docs(spark, rows[::-1], True), block_rows=64).collect()
    assert {(r.doc_id, r._copies) for r in again} == {(r.doc_id, r._copies) for r in out}


def test_every_document_stays_without_a_budget(spark):
    rows = corpus(600)
    out = mixing.mix(docs(spark, rows), budget_share=None)
    counts = Counter(r.doc_id for r in out.collect())
    assert set(counts) == {r[0] for r in rows} and max(counts.values()) <= mixing.MAX_REPEATS + 1
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_awkward_rows(spark):
    df = awkward(spark)
    out = mixing.copies(df, budget_share=None)
    added = ["_tokens", "_weight", "_copies"]
    assert out.columns == [*[c for c in df.columns if c not in added], *added] and out.count() == df.count()
    assert all(r._copies >= 1 for r in out.collect())
    assert mixing.mix(df, budget_share=None).columns == df.columns
    assert mixing.copies(docs(spark, [])).count() == 0
    assert [r._copies for r in mixing.copies(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]

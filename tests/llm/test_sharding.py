import zlib
from collections import Counter

from inkmeter.llm import sharding
from inkmeter.plans.oracle import same_rows
from tests.llm.helpers import awkward, docs


def check(rows, out, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots, sizes = {}, Counter()
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_balance_and_slots(spark):
    rows = [(i, "hot copy of one text" if i % 3 == 0 else "x" * (i % 211)) for i in range(3000)]
    sizes = check(rows, sharding.shard_by_bytes(docs(spark, rows, True)).collect(), 24)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * (211 + 8)


def test_awkward_rows(spark):
    df = awkward(spark)
    check([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], sharding.shard_by_bytes(df).collect(), 24)
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0
    assert [r.shard for r in sharding.shard_by_bytes(docs(spark, [(1, "only")])).collect()] == [0]


def test_oracle(spark, tiny):
    assert same_rows(sharding.op5_sharding(spark, tiny), sharding.ORACLE_SQL["op5_sharding"], tiny)


def test_main_path_is_native(spark, tiny):
    plan = sharding.op5_sharding(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

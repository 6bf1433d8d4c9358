import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keyweave.functions.predicates import lexicographic
from keyweave.model import INT_MAX, INT_MIN, UINT_MAX, Bound, Chunk, TableDef, saturating_add
from keyweave.plans import chunking as ck
from keyweave.plans.chunker import BatchControl, Chunker, SizeControl, WatermarkNotReady, drive, lazy_p90


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def probe_plan(keys, n):
    """The literal loop: the row n places behind the pointer, again and again."""
    keys, bounds, at = sorted(keys), [], None
    while True:
        rest = [k for k in keys if at is None or k > at]
        if len(rest) <= n:
            return bounds
        at = rest[n]
        bounds.append(at)


@pytest.mark.parametrize("n", [1, 3, 10, 1000])
def test_quantile_plan_equals_probing(spark, n):
    random.seed(n)
    keys = [(a, b) for a in range(20) for b in random.sample(range(50), 7)]
    df = spark.createDataFrame(keys, "a int, b int").repartition(5)
    plan = sorted((tuple(r) for r in ck.quantile_plan(df, ["a", "b"], n).collect()), key=lambda r: r[0])
    bounds = probe_plan(keys, n)
    assert [r[1:3] for r in plan] == [(None, None), *bounds]
    assert [r[3:5] for r in plan] == [*bounds, (None, None)]
    chunks = [Chunk(("a", "b"), lo[0] is not None and Bound(lo) or None, hi[0] is not None and Bound(hi, False) or None) for _, *x in plan for lo, hi in [(tuple(x[:2]), tuple(x[2:]))]]
    counts = [df.where(c.predicate()).count() for c in chunks]
    assert sum(counts) == len(keys)  # every row in exactly one chunk
    if len(counts) > 1:
        assert counts[0] == n and all(c == n + 1 for c in counts[1:-1])


def test_arithmetic_plan(spark):
    df = spark.createDataFrame([(k,) for k in (5, 6, 17, 25)], "k long")
    assert rows(ck.arithmetic_plan(df, "k", 10)) == [(0, None, 5), (1, 5, 15), (2, 15, 25), (3, 25, None)]
    assert rows(ck.arithmetic_plan(df.limit(0), "k", 10)) == [(0, None, 0), (1, 0, None)]


def test_empty_and_small_quantile_plan(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    assert rows(ck.quantile_plan(df, ["k"], 5)) == [(0, None, None)]
    assert rows(ck.quantile_plan(df.limit(0), ["k"], 5)) == [(0, None, None)]


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[st.integers(0, 2)] * 3), st.tuples(*[st.integers(0, 2)] * 3), st.sampled_from([">", ">=", "<", "<="]))
def test_lexicographic_is_tuple_order(spark, a, b, op):
    got = spark.range(1).select(lexicographic([F.lit(x) for x in a], b, op)).first()[0]
    assert got == {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def test_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, i) for i in range(10)], "a int, b int").write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").where(Chunk(("a", "b"), Bound((3, 1))).predicate())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,3)" in plan.split("PushedFilters")[1]


def test_chunk_json_round_trip():
    for values in ((1, "a'\"\\"), (b"\x00\xff", "0x12"), (2**63 - 1, None)):
        c = Chunk(("x", "y"), Bound(values), Bound(values, False), 7, "z > 'q'")
        assert Chunk.from_json(c.to_json()) == c


def test_saturating():
    assert saturating_add(INT_MAX, 5) == INT_MAX and saturating_add(INT_MIN, -5) == INT_MIN and saturating_add(UINT_MAX, 1, True) == UINT_MAX and saturating_add(1, -5, True) == 0


def test_key_is_needed(spark):
    with pytest.raises(ValueError):
        TableDef("t", spark.range(1).schema, ())


def test_chunker_order_and_end():
    c = Chunker("id", 1, 2500)
    got = list(c)
    assert got[0].lower is None and got[0].upper == Bound((1,), False)
    assert [x.lower.values[0] for x in got[1:]] == [1, 1001, 2001, 3001] and got[-1].upper is None
    assert c.next() is None


def test_low_watermark_out_of_order():
    c = Chunker("id", 1, 1_000_000)
    first, *more = [c.next() for _ in range(5)]
    with pytest.raises(WatermarkNotReady):
        c.low_watermark()
    c.feedback(first, 0.01)
    for x in (more[1], more[2]):
        c.feedback(x, 0.01)
    with pytest.raises(WatermarkNotReady):
        c.low_watermark()
    c.feedback(more[0], 0.01)
    assert Chunk.from_json(c.low_watermark()) == more[2]
    back = Chunker("id", 1, 1_000_000)
    back.resume(c.low_watermark())
    assert back.next().lower == more[2].lower


def test_high_watermark():
    c = Chunker("id", 1, 5000)
    assert c.above_high_watermark(3)
    c.next(), c.next()
    assert not c.above_high_watermark(1000) and c.above_high_watermark(1001)
    list(c)
    assert not c.above_high_watermark(10**9)


def test_size_feedback():
    s = SizeControl()
    s.feedback(1000, 1)
    assert s.size == 100
    s.feedback(1000, 1)  # of another size: ignored
    assert s.size == 100
    s.feedback(100, 1)
    assert s.size == 10
    for _ in range(10):
        s.feedback(10, 0.005)
    assert s.size == 10
    s.feedback(10, 0.005)
    assert s.size == 15
    assert lazy_p90([float(i) for i in range(1, 11)]) == 9


def test_batch_feedback():
    b = BatchControl()
    for seconds, want in ((0.1, 5000), (1, 500), (100, 5)):
        b.feedback(0, 5)
        for _ in range(10):
            b.feedback(1000, seconds)
        assert b.size == want


def test_drive_covers_sparse_keys_quickly():
    seen = []
    n = drive(Chunker("id", 1, 8_589_934, target_s=5), lambda c: seen.append(c) or 0.001)
    assert n == len(seen) < 500

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.digest import checksum
from keyweave.model import TableDef
from keyweave.operators import backfill, changes as ch, diff, transform

KEY = ["a"]


def df(spark, rows, ddl="a int, b string"):
    return spark.createDataFrame(rows, ddl)


def rows(d):
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_swap_cancels_in_crc_but_not_in_strict(spark):
    one, two = df(spark, [(1, "aa"), (2, "bb")]), df(spark, [(1, "bb"), (2, "aa")])
    same = lambda compat: checksum(one, ["a", "b"], compat=compat).collect() == checksum(two, ["a", "b"], compat=compat).collect()
    assert same(True) and not same(False)


def test_checksum_of_nothing_and_of_nulls(spark):
    assert rows(checksum(df(spark, []), ["a", "b"])) == [(0, 0)]
    assert rows(checksum(df(spark, [(1, None)]), ["a", "b"])) != rows(checksum(df(spark, [(1, "")]), ["a", "b"]))


def test_compat_rounds_seconds(spark):
    t = lambda x: spark.sql(f"SELECT 1 AS a, TIMESTAMP_NTZ '{x}' AS t")
    s = lambda x, c: rows(checksum(t(x), ["a", "t"], compat=c))
    assert s("2020-01-01 00:00:00.6", True) == s("2020-01-01 00:00:01", True)
    assert s("2020-01-01 00:00:00.6", False) != s("2020-01-01 00:00:01", False)


def test_digests_tell_all_rows_apart(spark):
    """Separators in texts, and doubles that differ beyond the cents."""
    same = lambda a, b: rows(checksum(a, a.columns)) == rows(checksum(b, b.columns))
    pair = "a string, b string"
    assert not same(df(spark, [("a", "b|0|c")], pair), df(spark, [("a|0|b", "c")], pair))
    assert not same(df(spark, [("1:", "x")], pair), df(spark, [("1", ":x")], pair)) and not same(df(spark, [(None, "-")], pair), df(spark, [("-", None)], pair))
    one = lambda x: df(spark, [(x,)], "x double")
    assert not same(one(1.001), one(1.004)) and not same(one(0.1 + 0.2), one(0.3)) and same(one(1e300), one(1e300))
    odd = spark.createDataFrame([(1, "x")], "`a.b` int, `c``d` string")
    assert rows(checksum(odd, odd.columns)) and rows(transform.project(odd, TableDef("t", odd.schema, ("a.b",)))) == [(1, "x")]


def test_lossy_casts_of_every_kind(spark):
    t = spark.sql("SELECT 1 AS a, 3.75D AS d, 1.239BD AS n, 300 AS i, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS s, 'abcdef' AS t, 0.1D AS f, '1.239' AS u, '007' AS z")
    casts = {"d": T.IntegerType(), "n": T.DecimalType(5, 2), "i": T.ByteType(), "s": T.DateType(), "t": T.StringType(), "f": T.FloatType(), "u": T.DecimalType(5, 2), "z": T.IntegerType()}
    assert {r.column for r in transform.lossy_rows(t, casts, ["a"], {"t": 5}).collect()} == {"d", "n", "i", "s", "t", "f", "u"}
    assert transform.lossy_rows(t, {"d": T.DecimalType(5, 2), "i": T.LongType(), "t": T.StringType()}, ["a"], {"t": 6}).count() == 0


def test_replace_displaces_rows_of_other_keys(spark):
    kind = "a int, u string, v int"
    target, source = df(spark, [(1, "x", 0), (2, "y", 0), (3, "z", 0)], kind), df(spark, [(2, "x", 1), (4, "z", 1), (5, "z", 2)], kind)
    changed = spark.createDataFrame([(1, 2, False), (2, 5, False), (3, 4, False)], CH)
    assert rows(ch.apply_changes(target, source, changed, KEY, unique=[["u"]])) == [(2, "x", 1), (4, "z", 1)]


def test_every_single_cell_change_is_found(spark):
    base = [(i, str(i)) for i in range(20)]
    whole = df(spark, base)
    for i in (0, 7, 19):
        other = df(spark, [(a, b + "x" if a == i else b) for a, b in base])
        assert [r.chunk_id for r in diff.diff_chunks(whole, other, ["a", "b"], F.col("a") % 5).where("not same").collect()] == [i % 5]
        assert [(r.a, r.kind) for r in diff.diff_rows(whole, other, ["a", "b"], KEY).collect()] == [(i, "mismatch")]


def test_diff_forms_agree_and_repair(spark):
    src = df(spark, [(1, "a"), (2, None), (3, "c")])
    tgt = df(spark, [(2, ""), (3, "c"), (4, "d")])
    got = {r.a: r.kind for r in diff.diff_rows(src, tgt, ["a", "b"], KEY).collect()}
    assert got == {1: "missing_in_target", 2: "mismatch", 4: "missing_in_source"}
    assert {r.a for r in diff.diff_rows_in_halves(src, tgt, ["a", "b"], KEY).collect()} == set(got)
    assert rows(diff.repaired(src, tgt, ["a", "b"], F.col("a") % 3)) == rows(src)
    assert diff.verify(src, tgt, ["a", "b"], F.col("a") % 3)[1] == 2
    with pytest.raises(diff.TablesDiffer):
        diff.verify(src, tgt, ["a", "b"], F.col("a") % 3, fix=False)


def test_insert_absent_is_idempotent(spark):
    tgt, more = df(spark, [(1, "x")]), df(spark, [(1, "y"), (2, "z")])
    once = backfill.insert_absent(tgt, more, KEY)
    assert rows(once) == [(1, "x"), (2, "z")] == rows(backfill.insert_absent(once, more, KEY))


def test_delete_and_replace_range_keep_null_keys(spark):
    t = df(spark, [(1, "x"), (None, "n"), (5, "y")])
    assert rows(backfill.delete_range(t, F.col("a") < 3)) == rows(df(spark, [(None, "n"), (5, "y")]))
    assert rows(backfill.replace_range(t, df(spark, [(2, "new")]), F.col("a") < 3)) == rows(df(spark, [(None, "n"), (5, "y"), (2, "new")]))


def test_last_per_unique(spark):
    t = df(spark, [(1, "u"), (2, "u"), (3, None), (4, None)])
    assert rows(backfill.last_per_unique(t, ["b"], ["a"])) == rows(df(spark, [(2, "u"), (3, None), (4, None)]))


def test_progress_texts():
    assert backfill.progress(5, 0) == 1 and backfill.eta(99995, 100000, 10, 100) == "DUE" and backfill.eta(1, 100, 10, 5) == "TBD" and backfill.eta(0, 7300, 1, 100) == "2h1m40s"
    h = backfill.EtaHistory()
    assert h.drift(0, 5) == ""
    h.add(0, 36_000)
    h.add(60, 1)  # within the hour: not kept
    assert h.drift(23 * 3600, 36_000 - 23 * 3600 - 1800) == "-30m from 23h ago"


CH = "seq long, a int, is_delete boolean"


def test_last_op_and_apply(spark):
    c = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 2, True), (4, 2, False), (5, 3, False), (6, 9, False)], CH)
    assert {(r.a, r.is_delete) for r in ch.last_op(c, KEY).collect()} == {(1, True), (2, False), (3, False), (9, False)}
    tgt, src = df(spark, [(1, "old"), (2, "old"), (4, "old")]), df(spark, [(2, "new"), (3, "new"), (4, "new")])
    assert rows(ch.apply_changes(tgt, src, c, KEY)) == [(2, "new"), (3, "new"), (4, "old")]
    assert rows(ch.refresh_keys(tgt, src, c, KEY)) == [(2, "new"), (3, "new"), (4, "old")]
    assert rows(ch.apply_changes(tgt, src, c.limit(0), KEY)) == rows(tgt)


def test_copy_then_changes_equals_changed_source(spark):
    before, after = df(spark, [(i, "v1") for i in range(10)]), df(spark, [(i, "v2" if i % 2 else "v1") for i in range(1, 12)])
    c = spark.createDataFrame([(i, i, i == 0) for i in [0, *range(1, 12, 2), 10]], CH)
    assert rows(ch.apply_changes(before, after, c, KEY)) == rows(after)


def test_runs(spark):
    c = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, False)], CH)
    assert [tuple(r) for r in ch.runs(c).orderBy("run_id").collect()] == [(1, False, 1, 2, 2), (2, True, 3, 3, 1), (3, False, 4, 4, 1)]
    gappy = spark.createDataFrame([(i * i * 10, i, i // 3 % 2 == 1) for i in range(60)], CH)
    assert [(r.n, r.first_seq, r.last_seq) for r in ch.runs(gappy).orderBy("run_id").collect()] == [(3, i * i * 10, (i + 2) ** 2 * 10) for i in range(0, 60, 3)]
    assert sorted(r.n for r in ch.runs(gappy, most=2).collect()) == [1] * 20 + [2] * 20
    assert ch.runs(gappy.limit(0)).collect() == []
    long = spark.createDataFrame([(i, i, False) for i in range(1, 8)], CH)
    assert [r.n for r in ch.runs(long, most=3).orderBy("first_seq").collect()] == [3, 3, 1]


def test_key_change_is_delete_and_upsert(spark):
    c = spark.createDataFrame([(1, False, 5, 6), (2, False, 7, 7), (3, True, None, 8)], "seq long, is_delete boolean, old_key int, a int")
    assert rows(ch.split_updates(c, "a").select("a", "is_delete")) == [(5, True), (6, False), (7, False), (8, True)]


def test_project_and_reports(spark):
    t = df(spark, [(1, "12"), (2, "x"), (3, None)])
    new = TableDef("t", T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType()), T.StructField("g", T.LongType())]), ("a",), {"g": "a * 2"}, {"c": "d"})
    assert rows(transform.project(t, new)) == [(1, 12, "d", 2), (2, None, "d", 4), (3, None, "d", 6)]
    assert [(r.a, r.value) for r in transform.lossy_rows(t, {"b": T.IntegerType()}, KEY).collect()] == [(2, "x")]
    assert rows(transform.null_rows(t, ["b"], KEY)) == [(3, "b")]
    with pytest.raises(transform.UnsafeConversion, match="does not fit"):
        transform.assert_safe(t, new)
    with pytest.raises(transform.UnsafeConversion, match="duplicate"):
        transform.assert_safe(df(spark, [(1, "1"), (2, "1")]), new, [("b",)])
    transform.assert_safe(df(spark, [(1, "1"), (2, "2")]), new, [("b",)])
    assert transform.shared_columns(["a", "b", "z"], ["b", "a", "g"], ["g"]) == ["a", "b"]

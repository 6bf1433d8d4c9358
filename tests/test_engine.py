import glob
import os

import pytest
from pyspark.sql import types as T

from keyweave import checks, registry
from keyweave.metrics import LagThrottle, LogSink, NoThrottle, chunk_metrics, report, wait_open
from keyweave.migrate import Migration, State, pass_through, statement_text
from keyweave.model import Bound, Chunk, TableDef
from keyweave.plans.ddl import UnsupportedStatement, evolve, metadata_only, parse, spark_type
from keyweave.sources.feed import position_available
from keyweave.sources.store import Locked, Store, lock_name, scratch

SF = "/root/testdata/sf0.001"
TABLE = TableDef("t", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())]), ("id",))


@pytest.mark.parametrize("sql, kinds", [
    ("ALTER TABLE t ADD COLUMN x DECIMAL(10,2) DEFAULT '1,5' AFTER b, DROP c", ["add_column", "drop_column"]),
    ("ALTER TABLE `s`.`t` MODIFY b VARCHAR(20) NOT NULL, ADD UNIQUE KEY u (b(10), c DESC)", ["modify", "add_unique"]),
    ("CREATE INDEX i ON t (b)", ["add_index"]),
])
def test_parse(sql, kinds):
    assert [c.kind for c in parse(sql).clauses] == kinds


def test_parse_refuses():
    for sql in ("SELECT 1", "ALTER TABLE t ADD x INT; DROP TABLE t", "ALTER TABLE t FROBNICATE"):
        with pytest.raises(UnsupportedStatement):
            parse(sql)


def test_evolve():
    new = evolve(TABLE, parse("ALTER TABLE t ADD COLUMN x DECIMAL(10,2) DEFAULT '1.5' AFTER id, MODIFY c BIGINT UNSIGNED, DROP COLUMN b, ADD INDEX i (c)"))
    assert [(f.name, f.dataType.simpleString()) for f in new.schema.fields] == [("id", "bigint"), ("x", "decimal(10,2)"), ("c", "decimal(20,0)")]
    assert new.defaults == {"x": "1.5"} and new.indexes == {"i": ("c",)}
    with pytest.raises(UnsupportedStatement):
        evolve(TABLE, parse("ALTER TABLE t DROP COLUMN id"))
    assert metadata_only(parse("ALTER TABLE t DROP INDEX i")) and not metadata_only(parse("ALTER TABLE t DROP INDEX i, ADD x INT"))
    assert spark_type("mediumint") == T.IntegerType() and spark_type("longblob") == T.BinaryType()


def test_checks_name_the_refusing_one():
    with pytest.raises(checks.CheckFailed, match="settings"):
        checks.run("prerun", checks.Resources(threads=0))
    with pytest.raises(checks.CheckFailed, match="privileges"):
        checks.run("preflight", checks.Resources(parse("ALTER TABLE t ADD x INT"), writable=lambda: False))
    assert checks.run("cutover", checks.Resources()) == ["lock", "drift"] and checks.run("testing", checks.Resources()) == []
    with pytest.raises(checks.CheckFailed, match="lock"):
        checks.run("cutover", checks.Resources(lock_held=lambda: False))


def test_a_watched_replica_must_tell_its_lag():
    def broken():
        raise OSError("no answer")

    for lag in (broken, lambda: None, lambda: -1.0, lambda: float("nan")):
        for scope in ("preflight", "post_setup"):
            with pytest.raises(checks.CheckFailed, match="replica_health"):
                checks.run(scope, checks.Resources(parse("ALTER TABLE t ADD x INT"), lag=lag))
    for lag in (None, lambda: 0.0, lambda: 1e6):  # a slow replica closes the throttle, it is not ill
        assert "replica_health" in checks.run("preflight", checks.Resources(parse("ALTER TABLE t ADD x INT"), lag=lag))


def test_metrics_and_throttle():
    class Broken:
        def send(self, metrics):
            raise RuntimeError

    assert not report(Broken(), chunk_metrics(0.1, 5, 5)) and report(LogSink(), chunk_metrics(0.1, 5, 5))
    now, lags = [0.0], [100.0, 1.0]
    t = LagThrottle(lambda: lags.pop(0), 10, lambda: now[0])
    assert wait_open(t, lambda s: now.__setitem__(0, now[0] + s)) == 5
    assert wait_open(NoThrottle()) == 0


def test_store(spark):
    s = Store(spark, scratch(spark))
    a = s.write(spark.range(3).toDF("id"))
    assert s.swap(a) is None and s.read().count() == 3
    b = s.write(spark.range(4).toDF("id"))
    assert s.swap(b) == a and s.read().count() == 4
    with pytest.raises(ValueError):
        s.drop(b)
    s.drop(a)
    s.lock()
    with pytest.raises(Locked):
        Store(spark, s.base).lock()
    Store(spark, s.base).lock("other", "table")
    s.unlock()
    s.lock(lease_s=0.0, clock=lambda: 0.0)  # a driver that died long ago
    s._beat.set()
    heir = Store(spark, s.base)
    heir.lock()
    assert heir.held() and not s.held()
    assert s.load_checkpoint() is None
    fields = dict.fromkeys(Store.FIELDS, 1)
    s.save_checkpoint(**fields)
    s.save_checkpoint(**fields | {"position": 2})
    assert s.load_checkpoint()["position"] == 2
    assert len(s.files.names("checkpoints")) == 2
    s.files.write("checkpoints/00000009.json", '{"other": 1}')
    with pytest.raises(ValueError):
        s.load_checkpoint()
    assert lock_name("s" * 30, "t").startswith("s" * 20 + ".t-")


def _store(spark, n=2500):
    s = Store(spark, scratch(spark))
    s.swap(s.write(spark.range(n).selectExpr("id", "concat('v', id) AS b", "cast(id % 7 AS int) AS c")))
    return s


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_migration_with_changes(spark):
    s = _store(spark)
    after = spark.range(10, 2510).selectExpr("id", "concat('w', id) AS b", "cast(id % 7 AS int) AS c")
    changes = spark.range(2510).selectExpr("id AS seq", "id AS key", "id < 10 AS is_delete")
    m = Migration(s, TABLE, "ALTER TABLE t ADD COLUMN d INT DEFAULT 4, DROP COLUMN c", lambda p: changes.where(f"seq > {p}"), lambda: after, target_chunk_s=5)
    assert m.run() == "copy" and m.state == State.CLOSED
    assert _rows(s.read()) == sorted(((i, f"w{i}", 4) for i in range(10, 2510)), key=str)
    assert m.status().state == "CLOSED" and s.load_checkpoint() is None


def test_migration_resumes(spark, monkeypatch):
    """Killed in the middle of the copy: finished chunks stay, half-done folders go, the rest is copied."""
    s = _store(spark)
    sql = "ALTER TABLE t MODIFY c BIGINT"
    copy, copied = Migration._copy_chunk, []

    def dies(self, i):
        copied.append(i)
        if i == 3:
            s.write(spark.range(1).toDF("id"), f"{self.shadow}/chunk00003-half")
            raise KeyboardInterrupt
        return copy(self, i)

    monkeypatch.setattr(Migration, "_copy_chunk", dies)
    first = Migration(s, TABLE, sql, chunk_size=500, threads=1)
    with pytest.raises(KeyboardInterrupt):
        first.run()
    assert first.state == State.FAILED and copied == [0, 1, 2, 3] and s.load_checkpoint()["rows_copied"] == 1500
    monkeypatch.setattr(Migration, "_copy_chunk", lambda self, i: copied.append(i) or copy(self, i))
    again = Migration(s, TABLE, sql, chunk_size=500)
    again.run()
    assert again.resumed and again.passes == 1 and sorted(copied) == [0, 1, 2, 3, 3, 4] and again.copied == 2500
    assert s.read().count() == 2500 and s.read().schema["c"].dataType == T.LongType() and s.definition().schema["c"].dataType == T.LongType()
    assert not any("half" in n for n in s.files.names(again.shadow))


def test_comparison_resumes_and_repairs(spark, monkeypatch):
    from keyweave import migrate
    from keyweave.operators.diff import TablesDiffer

    monkeypatch.setattr(migrate, "COMPARED", 2)
    s = _store(spark)
    sql = "ALTER TABLE t ADD INDEX i (b)"
    copy = Migration._copy_chunk

    def spoiled(self, i):
        got = copy(self, i)
        if i == 3:
            s.write(self.store.read_parts(self.schema, [self.parts[i]]).where("id <> 1700"), f"{self.shadow}/chunk00003-spoiled")
            self.parts[i] = f"{self.shadow}/chunk00003-spoiled"
        return got

    monkeypatch.setattr(Migration, "_copy_chunk", spoiled)
    first = Migration(s, TABLE, sql, chunk_size=500, fix=False)
    with pytest.raises(TablesDiffer):
        first.run()
    assert s.load_checkpoint()["checksum_watermark"] == "2"
    monkeypatch.setattr(Migration, "_copy_chunk", copy)
    again = Migration(s, TABLE, sql, chunk_size=500)
    again.run()
    assert again.resumed and again.passes == 2 and s.read().count() == 2500


def test_changes_at_cut_over_are_not_lost(spark):
    """The owner writes until it is blocked; the barrier waits for the feed, and all of it is flushed before the swap."""
    from contextlib import contextmanager

    s = _store(spark, 100)
    rows, log = {i: f"v{i}" for i in range(100)}, []

    def write(k, v):
        rows[k] = v
        log.append((len(log), k, False))

    @contextmanager
    def blocked():
        write(7, "late")
        write(1000, "new")
        yield

    m = Migration(
        s, TABLE, "ALTER TABLE t DROP COLUMN c", lambda p: spark.createDataFrame([x for x in log if x[0] > p], "seq long, key long, is_delete boolean"),
        lambda: spark.createDataFrame([(k, v, 0) for k, v in rows.items()], s.read(m.source_name).schema), blocked, lambda: len(log) - 1, chunk_size=10, flush_s=0)
    write(1, "early")
    m.run()
    assert dict(map(tuple, s.read().collect())) == rows and m.position == len(log) - 1


def test_lossy_alter_is_refused_and_keyless_changes_are_errors(spark):
    from keyweave.operators.transform import UnsafeConversion
    from keyweave.sources.feed import NullKey

    s = Store(spark, scratch(spark))
    s.swap(s.write(spark.sql("SELECT 1L AS id, 'long text' AS b, 3.75D AS c")))
    t = TableDef("t", s.read().schema, ("id",))
    for sql in ("ALTER TABLE t MODIFY c INT", "ALTER TABLE t MODIFY c DECIMAL(5,1)", "ALTER TABLE t MODIFY b VARCHAR(5)"):
        with pytest.raises(UnsafeConversion):
            Migration(s, t, sql).run()
    with pytest.raises(NullKey):
        Migration(s, t, "ALTER TABLE t MODIFY c DECIMAL(5,2)", lambda p: spark.sql("SELECT 1L AS seq, cast(NULL AS long) AS key, true AS is_delete")).run()


def test_flush_rewrites_touched_chunks_only(spark):
    s = _store(spark)
    log = spark.createDataFrame([(1, 700, True)], "seq long, key long, is_delete boolean")
    m = Migration(s, TABLE, "ALTER TABLE t ADD COLUMN d INT", lambda p: log.where(f"seq > {p}"), lambda: s.read(m.source_name).where("id <> 700"), chunk_size=500, threads=9)
    m.run()
    assert [i for i, f in m.parts.items() if "flush" in f] == [1] and len(m.parts) == 5 and s.read().count() == 2499


def test_composite_key_migrates_with_changes(spark):
    s = Store(spark, scratch(spark))
    s.swap(s.write(spark.range(1000).selectExpr("concat('k', id % 9) AS a", "DATE '2024-01-01' + cast(id AS int) AS b", "id AS v")))
    t = TableDef("t", s.read().schema, ("a", "b"))
    log = s.read().where("v % 100 = 0").selectExpr("v AS seq", "struct(a, b) AS key", "v = 300 AS is_delete")
    live = lambda: s.read(m.source_name).where("v <> 300").selectExpr("a", "b", "if(v % 100 = 0, -v, v) AS v")
    m = Migration(s, t, "ALTER TABLE t ADD COLUMN w INT", lambda p: log.where(f"seq > {p}"), live, chunk_size=100, flush_s=0)
    m.run()
    assert len(m.chunks) == 10 and sorted(r.v for r in s.read().collect()) == sorted(-i if i % 100 == 0 else i for i in range(1000) if i != 300)
    assert [Chunk.from_json(c.to_json()) for c in m.chunks] == m.chunks


@pytest.mark.parametrize("key", [("a", "b"), ("t",)])
def test_many_chunks_take_few_reads_of_the_source(spark, monkeypatch, key):
    """One job copies several neighbours, changes between rounds come in, and a killed copy goes on behind its rounds."""
    rows = spark.range(1000).selectExpr("id % 7 AS a", "id AS b", "concat('k', id) AS t", "id AS v")
    log = rows.where("v % 100 = 0").selectExpr("v AS seq", "struct(a, b) AS key" if len(key) == 2 else "t AS key", "v = 300 AS is_delete")
    live = rows.where("v <> 300").selectExpr("a", "b", "t", "if(v % 100 = 0, -v, v) AS v")
    want = sorted(-i if i % 100 == 0 else i for i in range(1000) if i != 300)

    def make(s):
        return Migration(s, TableDef("t", rows.schema, key), "ALTER TABLE t ADD COLUMN w INT DEFAULT 3", lambda p: log.where(f"seq > {p}"), lambda: live, chunk_size=12, flush_s=0)

    read, reads, copy = Migration._source_now, [], Migration._copy

    def counted(self):
        monkeypatch.setattr(Migration, "_source_now", lambda self: reads.append(1) or read(self))
        monkeypatch.setattr(Migration, "_flush", lambda self: 0)
        copy(self)
        monkeypatch.undo()

    monkeypatch.setattr(Migration, "_copy", counted)
    s = Store(spark, scratch(spark))
    s.swap(s.write(rows))
    m = make(s)
    m.run()
    assert len(m.chunks) == 77 and len(reads) <= 16 and m.copied == 999
    assert sorted(r.v for r in s.read().collect()) == want and {r.w for r in s.read().collect()} == {3}

    s = Store(spark, scratch(spark))
    s.swap(s.write(rows))
    save, saves = Migration._save, []

    def dies(self):
        save(self)
        saves.append(len(self.done))
        if len(saves) == 3:
            raise KeyboardInterrupt

    monkeypatch.setattr(Migration, "_save", dies)
    with pytest.raises(KeyboardInterrupt):
        make(s).run()
    monkeypatch.undo()
    assert 0 < saves[-1] < 77
    m = make(s)
    m.run()
    assert m.resumed and m.passes == 1 and sorted(r.v for r in s.read().collect()) == want


def test_chunk_numbers_of_bounds_with_equal_first_values(spark):
    from keyweave.migrate import chunk_number
    from keyweave.model import Bound

    rows = spark.range(600).selectExpr("id div 60 AS a", "concat('k', id % 60) AS b", "id % 5 AS c")
    at = sorted({(r.a, r.b, r.c + d) for r in rows.where("c = 3 and a in (2, 3, 9)").collect() for d in (-1, 0)})
    edges = [None, *at, None]
    chunks = [Chunk(("a", "b", "c"), x and Bound(x), y and Bound(y, False)) for x, y in zip(edges, edges[1:])]
    for r in rows.withColumn("n", chunk_number(chunks)).collect():
        assert r.n == sum(x <= (r.a, r.b, r.c) for x in at)
    assert {r.n for r in rows.select(chunk_number(chunks[:1]).alias("n")).collect()} == {0}


def test_streams_do_not_take_each_others_batches(spark, tmp_path):
    from keyweave.streaming.apply import apply_stream, stateful_last_op

    s = _store(spark, 10)
    schema = spark.range(1).selectExpr("id AS seq", "id", "true AS is_delete").schema
    for n in (1, 2):  # two streams, each with its own batch 0, and each run twice
        spark.range(n, n + 1).selectExpr("id AS seq", "id", "true AS is_delete").write.parquet(f"{tmp_path}/in{n}")
        for _ in range(2):
            apply_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in{n}"), s, lambda: s.read(), ["id"], f"{tmp_path}/check{n}")
    assert sorted(r.id for r in s.read().collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    state = Store(spark, scratch(spark))
    for _ in range(2):
        got = stateful_last_op(spark.readStream.schema(schema).parquet(f"{tmp_path}/in1"), state, "id", f"{tmp_path}/check3")
        assert [tuple(r) for r in got.collect()] == [(1, True, 1)]


def test_other_alter_does_not_resume(spark):
    s = _store(spark, 50)
    with pytest.raises(TimeoutError):
        Migration(s, TABLE, "ALTER TABLE t MODIFY c BIGINT", target_chunk_s=5, chunk_size=20, defer_cutover=True).run()
    s.files.delete("SENTINEL")
    with pytest.raises(ValueError):
        Migration(s, TABLE, "ALTER TABLE t DROP COLUMN c", target_chunk_s=5, strict=True).run()
    m = Migration(s, TABLE, "ALTER TABLE t DROP COLUMN c", target_chunk_s=5)
    m.run()
    assert not m.resumed and s.read().columns == ["id", "b"]


def test_metadata_path_copies_nothing(spark):
    s = _store(spark, 5)
    before = s.current()
    t = TableDef("t", TABLE.schema, ("id",), indexes={"i": ("b",), "j": ("c",)})
    assert Migration(s, t, "ALTER TABLE t DROP INDEX i").run() == "metadata" and s.current() == before and s.definition().indexes == {"j": ("c",)}


def test_statements_as_they_are(spark):
    pass_through(spark, "CREATE TABLE kw_a (x INT) USING parquet")
    pass_through(spark, "RENAME TABLE kw_a TO kw_b")
    assert spark.catalog.tableExists("kw_b") and not spark.catalog.tableExists("kw_a")
    pass_through(spark, "DROP TABLE kw_b")
    with pytest.raises(ValueError):
        pass_through(spark, "ALTER TABLE t ADD x INT")
    assert statement_text(table="t", alter=" DROP x ") == "ALTER TABLE `t` DROP x"
    for bad in ({}, {"statement": "s", "table": "t", "alter": "a"}, {"table": "t"}):
        with pytest.raises(ValueError):
            statement_text(**bad)


def test_position(spark):
    f = spark.range(5, 9).toDF("seq")
    assert position_available(f, 4) and not position_available(f, 3) and not position_available(f.limit(0), 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    if name == "chunk_plan_four_part":
        pytest.skip("its key has duplicates at this scale")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    form = lambda r: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(form(r) for r in df.select(*cols).collect()) == sorted(form([r[names.index(c)] for c in cols]) for r in got.fetchall())


def test_queries_without_sql(spark):
    if os.path.isdir(SF):
        assert registry.QUERIES["checksum_crc32_compat"](spark, SF).count() == 2


@pytest.mark.parametrize("name", ["changes_stream_apply", "changes_stateful_stream"])
def test_streams_read_tables_of_part_files(spark, tmp_path, name):
    for t in ("events", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    want, got = (sorted(map(tuple, registry.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
    assert got == want and got


def test_empty_stream_gives_empty_state(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["changes_stateful_stream"](spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["c_custkey", "is_delete", "seq"]

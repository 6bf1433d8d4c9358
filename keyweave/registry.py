"""Every query over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from keyweave import checks, metrics
from keyweave.functions.digest import checksum, row_digest
from keyweave.functions.predicates import lexicographic
from keyweave.migrate import Migration
from keyweave.model import Bound, Chunk, TableDef
from keyweave.operators import backfill, changes as ch, diff, transform
from keyweave.plans import chunking as ck
from keyweave.plans.chunker import BatchControl, Chunker, SizeControl
from keyweave.plans.ddl import adds_unique, metadata_only, parse
from keyweave.sources import feed
from keyweave.sources.store import Store, lock_name as store_lock_name, scratch
from keyweave.streaming.apply import apply_stream, stateful_last_op

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables and their drifted copies -------------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ALL = "o_orderkey, o_custkey, o_orderstatus, {price} AS o_totalprice, o_orderdate, o_orderpriority"
TARGET_SQL = f"""SELECT {_ALL.format(price='CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END')} FROM orders WHERE o_orderkey % 101 <> 0
UNION ALL SELECT {_ALL.format(price='o_totalprice').replace('o_orderkey,', 'o_orderkey + 10000000,', 1)} FROM orders WHERE o_orderkey % 103 = 0"""


def drifted(orders: DataFrame) -> DataFrame:
    """A copy of orders with changed, missing and surplus rows."""
    changed = orders.where("o_orderkey % 101 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    return changed.unionByName(orders.where("o_orderkey % 103 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000))


def _digest_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    form = {"o_totalprice": f"CAST(CAST(round({a}o_totalprice * 100) AS BIGINT) AS VARCHAR)", "o_orderdate": f"strftime({a}o_orderdate, '%Y-%m-%d %H:%M:%S.%f')"}
    texts = [form.get(c, f"CAST({a}{c} AS VARCHAR)") for c in ORDER_COLUMNS]
    parts = [f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts]
    return f"CAST('0x' || substr(md5({' || '.join(parts)}), 1, 15) AS BIGINT)"


DIGEST = _digest_sql()
CHUNK_SQL = "CAST(floor(o_orderkey / 1000) AS BIGINT)"


def _chunk() -> Column:
    return F.floor(F.col("o_orderkey") / 1000).cast("long").alias("chunk_id")


def in_cents(orders: DataFrame) -> DataFrame:
    """Prices as whole cents: the text of a double is not the same in all engines, that of an integer is."""
    return orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("bigint"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.read_feed(spark, f"{sf_dir}/events.parquet", "event_id", "user_id", "event_type = 'error'").withColumnRenamed("key", "c_custkey")


def stale(customer: DataFrame) -> DataFrame:
    """A customer copy that lacks some keys and has old balances."""
    return customer.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.col("c_acctbal") - 1)


LAST_SQL = "SELECT user_id AS c_custkey, arg_max(event_type = 'error', event_id) AS is_delete, max(event_id) AS seq FROM events GROUP BY user_id"
APPLIED_SQL = f"""WITH last AS ({LAST_SQL})
SELECT c_custkey, c_name, c_nationkey, CAST(round((c_acctbal - 1) * 100) AS BIGINT) AS cents FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT c_custkey FROM last)
UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT c_custkey FROM last WHERE NOT is_delete)"""


def _cents(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_name", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))


# Statistics and chunk plans ------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_rows, coalesce(min(o_orderkey), 0) AS min_key, coalesce(max(o_orderkey), 0) AS max_key FROM orders")
def table_stats(spark, sf_dir):
    return ck.key_stats(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) t(ordinal, column_name, data_type)")
def table_columns(spark, sf_dir):
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(table(spark, sf_dir, "orders").schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")


@query("""WITH s AS (SELECT min(o_orderkey) lo, max(o_orderkey) hi FROM orders), n AS (SELECT lo, CAST(ceil((hi - lo) / 1000.0) AS BIGINT) AS n FROM s)
SELECT i AS chunk_id, CASE WHEN i > 0 THEN lo + (i - 1) * 1000 END AS lower, CASE WHEN i <= n THEN lo + i * 1000 END AS upper FROM n, range(0, n + 2) r(i)""")
def chunk_plan_arithmetic(spark, sf_dir):
    return ck.arithmetic_plan(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


def _quantile_sql(source: str, key: list[str], size: int, where: str = "true") -> str:
    cols = ", ".join(key)
    lowers = ", ".join(f"{c} AS lower_{c}" for c in key)
    uppers = ", ".join(f"lead({c}) OVER (ORDER BY chunk_id) AS upper_{c}" for c in key)
    return f"""WITH r AS (SELECT {cols}, row_number() OVER (ORDER BY {cols}) AS rn FROM {source} WHERE {where}),
b AS (SELECT CAST(rn // {size + 1} AS BIGINT) AS chunk_id, {cols} FROM r WHERE rn % {size + 1} = 0 UNION ALL SELECT 0, {', '.join('NULL' for _ in key)})
SELECT chunk_id, {lowers}, {uppers} FROM b"""


@query(_quantile_sql("labels", ["doc_id"], 50))
def chunk_plan_quantile_single(spark, sf_dir):
    return ck.quantile_plan(table(spark, sf_dir, "labels"), ["doc_id"], 50)


@query(_quantile_sql("orders", ["o_custkey", "o_orderkey"], 1000))
def chunk_plan_quantile_composite(spark, sf_dir):
    return ck.quantile_plan(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 1000)


FOUR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(_quantile_sql("lineitem", FOUR, 5000))
def chunk_plan_four_part(spark, sf_dir):
    return ck.quantile_plan(table(spark, sf_dir, "lineitem"), FOUR, 5000)


@query(_quantile_sql("orders", ["o_orderstatus", "o_orderkey"], 500, "o_totalprice > 100000"))
def chunk_plan_filtered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    t = TableDef("orders", orders.schema, ("o_orderkey",), indexes={"s": ("o_orderstatus",)})
    return ck.quantile_plan(orders, t.index_key("s"), 500, "o_totalprice > 100000")


@query("""WITH r AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS nxt FROM labels) SELECT doc_id AS gap_start, nxt AS gap_end FROM r WHERE nxt - doc_id > 3""")
def chunk_gap_skip(spark, sf_dir):
    return ck.gaps(table(spark, sf_dir, "labels"), "doc_id", 3)


@query("WITH s AS (SELECT min(o_orderkey) lo FROM orders) SELECT CAST(floor((o_orderkey - lo) / 1000) AS BIGINT) + 1 AS chunk_id, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders, s GROUP BY 1")
def chunk_row_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    low = orders.agg(F.min("o_orderkey").alias("_low"))
    placed = orders.join(F.broadcast(low)).withColumn("chunk_id", ck.arithmetic_chunk("o_orderkey", F.col("_low"), 1000))
    return placed.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders) SELECT CAST(rn // 1001 AS BIGINT) AS chunk_id, count(*) AS n_rows FROM r GROUP BY 1")
def chunk_size_n_plus_one(spark, sf_dir):
    return ck.quantile_chunk(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 1000).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
WHERE (o_custkey > 300 OR (o_custkey = 300 AND o_orderkey >= 5000)) AND (o_custkey < 900 OR (o_custkey = 900 AND o_orderkey < 2000))""")
def row_range_scan_composite(spark, sf_dir):
    chunk = Chunk(("o_custkey", "o_orderkey"), Bound((300, 5000)), Bound((900, 2000), False))
    return table(spark, sf_dir, "orders").where(chunk.predicate()).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (20, 2) AND role <> 'system'")
def row_range_scan_extra(spark, sf_dir):
    chunk = Chunk(("conv_id", "turn"), Bound((20, 2), False), None, extra="role <> 'system'")
    return table(spark, sf_dir, "conversations").where(chunk.predicate()).select("conv_id", "turn", "role")


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1 OFFSET 1000")
def boundary_probe(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").offset(1000).limit(1)


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_orderkey IN (SELECT DISTINCT user_id * 3 FROM events)")
def key_lookup_scan(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


# Digests and differences ---------------------------------------------------------------------------------------------


@query(f"SELECT {CHUNK_SQL} AS chunk_id, count(*) AS n_rows, bit_xor({DIGEST}) AS digest FROM orders GROUP BY 1")
def checksum_by_chunk(spark, sf_dir):
    return checksum(in_cents(table(spark, sf_dir, "orders")).withColumn("chunk_id", _chunk()), ORDER_COLUMNS, ["chunk_id"])


@query(f"SELECT count(*) AS n_rows, coalesce(bit_xor({DIGEST}), 0) AS digest FROM orders")
def checksum_whole_table(spark, sf_dir):
    return checksum(in_cents(table(spark, sf_dir, "orders")), ORDER_COLUMNS)


@query()
def checksum_crc32_compat(spark, sf_dir):
    return checksum(table(spark, sf_dir, "orders").withColumn("chunk_id", _chunk()), ORDER_COLUMNS, ["chunk_id"], compat=True)


@query(f"""WITH t AS ({TARGET_SQL}), a AS (SELECT {CHUNK_SQL} AS chunk_id, count(*) AS n, bit_xor({DIGEST}) AS d FROM orders GROUP BY 1),
b AS (SELECT {CHUNK_SQL} AS chunk_id, count(*) AS n, bit_xor({DIGEST}) AS d FROM t GROUP BY 1)
SELECT chunk_id, coalesce(a.n, 0) AS source_rows, coalesce(a.d, 0) AS source_digest, coalesce(b.n, 0) AS target_rows, coalesce(b.d, 0) AS target_digest,
coalesce(a.n, 0) = coalesce(b.n, 0) AND coalesce(a.d, 0) = coalesce(b.d, 0) AS same FROM a FULL JOIN b USING (chunk_id)""")
def diff_chunks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return diff.diff_chunks(in_cents(orders), in_cents(drifted(orders)), ORDER_COLUMNS, _chunk())


_SIDES = f"WITH t AS ({TARGET_SQL}), a AS (SELECT o_orderkey, {DIGEST} AS source_digest FROM orders), b AS (SELECT o_orderkey, {DIGEST} AS target_digest FROM t)"


@query(f"""{_SIDES} SELECT o_orderkey, CASE WHEN target_digest IS NULL THEN 'missing_in_target' WHEN source_digest IS NULL THEN 'missing_in_source' ELSE 'mismatch' END AS kind,
source_digest, target_digest FROM a FULL JOIN b USING (o_orderkey) WHERE source_digest IS DISTINCT FROM target_digest""")
def diff_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return diff.diff_rows(in_cents(orders), in_cents(drifted(orders)), ORDER_COLUMNS, ["o_orderkey"])


@query(f"""{_SIDES} SELECT o_orderkey, source_digest, target_digest FROM a LEFT JOIN b USING (o_orderkey) WHERE target_digest IS NULL OR source_digest <> target_digest
UNION SELECT o_orderkey, source_digest, target_digest FROM b LEFT JOIN a USING (o_orderkey) WHERE source_digest IS NULL OR source_digest <> target_digest""")
def diff_rows_union_form(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return diff.diff_rows_in_halves(in_cents(orders), in_cents(drifted(orders)), ORDER_COLUMNS, ["o_orderkey"])


@query(f"""WITH t AS ({TARGET_SQL}), a AS (SELECT {CHUNK_SQL} AS c, count(*) AS n, bit_xor({DIGEST}) AS d FROM orders GROUP BY 1), b AS (SELECT {CHUNK_SQL} AS c, count(*) AS n, bit_xor({DIGEST}) AS d FROM t GROUP BY 1),
bad AS (SELECT c FROM a FULL JOIN b USING (c) WHERE a.n IS DISTINCT FROM b.n OR a.d IS DISTINCT FROM b.d)
SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM t WHERE {CHUNK_SQL} NOT IN (SELECT c FROM bad)
UNION ALL SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE {CHUNK_SQL} IN (SELECT c FROM bad)""")
def repair_result(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fixed = diff.repaired(orders, drifted(orders), ORDER_COLUMNS, _chunk())
    return fixed.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def verify_until_equal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    store = Store(spark, scratch(spark))
    fixed, _ = diff.verify(orders, drifted(orders), ORDER_COLUMNS, _chunk(), lambda df: store.read(store.write(df)))
    return fixed.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


# Copies and conversions ----------------------------------------------------------------------------------------------


def _new_orders(orders: DataFrame) -> TableDef:
    f = {x.name: x for x in orders.schema.fields}
    schema = T.StructType([f["o_orderkey"], T.StructField("o_custkey", T.StringType()), f["o_orderstatus"], T.StructField("region", T.StringType()), T.StructField("note", T.StringType()), T.StructField("half_key", T.LongType())])
    return TableDef("orders", schema, ("o_orderkey",), {"half_key": "o_orderkey div 2"}, {"region": "none"})


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, 'none' AS region, CAST(NULL AS VARCHAR) AS note, o_orderkey // 2 AS half_key FROM orders")
def copy_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return transform.project(orders, _new_orders(orders))


@query("SELECT c_custkey, c_nationkey, 2 * c_nationkey + 1 AS odd_key, c_mktsegment || '-' || c_nationkey AS tag FROM customer")
def generated_column_recompute(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").withColumns({"odd_key": F.lit(0), "tag": F.lit("old")})
    schema = T.StructType([customer.schema["c_custkey"], customer.schema["c_nationkey"], customer.schema["c_mktsegment"], T.StructField("odd_key", T.IntegerType()), T.StructField("tag", T.StringType())])
    t = TableDef("customer", schema, ("c_custkey",), {"odd_key": "2 * c_nationkey + 1", "tag": "concat(c_mktsegment, '-', c_nationkey)"})
    return transform.project(customer, t).drop("c_mktsegment")


@query("""SELECT o_orderkey, o_custkey, o_totalprice + 5 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0""")
def copy_insert_ignore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    there = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 5)
    return backfill.insert_absent(there, orders, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def copy_resume_from_lower_bound(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chunker = Chunker("o_orderkey", 0, 1000)
    chunker.resume(Chunk(("o_orderkey",), Bound((300,)), Bound((400,), False), 100).to_json())
    copied = orders.where("o_orderkey < 430")  # some rows behind the watermark's lower bound are there already
    return backfill.insert_absent(copied, orders.where(lexicographic(["o_orderkey"], [chunker.pointer], ">=")), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 2000 OR o_orderkey >= 4000 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 4000")
def replace_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return backfill.replace_range(orders, orders.withColumn("o_totalprice", F.col("o_totalprice") * 2), Chunk(("o_orderkey",), Bound((2000,)), Bound((4000,), False)).predicate())


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 2000 OR o_orderkey >= 4000")
def delete_range(spark, sf_dir):
    return backfill.delete_range(table(spark, sf_dir, "orders").select("o_orderkey"), Chunk(("o_orderkey",), Bound((2000,)), Bound((4000,), False)).predicate())


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def delete_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return backfill.delete_keys(table(spark, sf_dir, "customer").select("c_custkey"), keys, ["c_custkey"])


@query("SELECT c_nationkey, max(c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def replace_unique_side_effect(spark, sf_dir):
    return backfill.last_per_unique(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"])


@query("""SELECT 'o_orderpriority' AS column_name, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL HAVING count(*) > 0
UNION ALL SELECT 'o_totalprice', count(*) FROM orders WHERE o_totalprice <> trunc(o_totalprice) OR abs(o_totalprice) >= 2147483648 HAVING count(*) > 0
UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE length(o_orderstatus) > 0 HAVING count(*) > 0
UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE o_custkey NOT BETWEEN -128 AND 127 HAVING count(*) > 0
UNION ALL SELECT 'o_orderdate', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <> o_orderdate HAVING count(*) > 0
UNION ALL SELECT 'half', count(*) FROM orders WHERE CAST(o_orderkey AS DOUBLE) / 2 <> CAST(CAST(o_orderkey AS DOUBLE) / 2 AS DECIMAL(18, 0)) HAVING count(*) > 0
UNION ALL SELECT 'name', count(*) FROM orders WHERE length('n' || o_orderkey) > 4 HAVING count(*) > 0""")
def cast_lossy_report(spark, sf_dir):
    """Texts that are no numbers, fractions cut, values out of range, times of day cut, scale lost, and texts too long."""
    orders = table(spark, sf_dir, "orders").withColumns({"half": F.col("o_orderkey").cast("double") / 2, "name": F.concat(F.lit("n"), F.col("o_orderkey"))})
    casts = {"o_orderpriority": T.IntegerType(), "o_totalprice": T.IntegerType(), "o_orderstatus": T.StringType(), "o_custkey": T.ByteType(), "o_orderdate": T.DateType(), "half": T.DecimalType(18, 0), "name": T.StringType()}
    bad = transform.lossy_rows(orders, casts, ["o_orderkey"], {"name": 4, "o_orderstatus": 0})
    return bad.groupBy(F.col("column").alias("column_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey % 10 AS bucket, count(*) AS texts, count(*) AS digests FROM (SELECT DISTINCT o_orderkey, x FROM orders, range(0, 3) r(x)) GROUP BY 1")
def digest_collisions(spark, sf_dir):
    """Rows that look alike when joined by a separator, or when rounded: as many digests as there are rows."""
    orders, shape = table(spark, sf_dir, "orders").select("o_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("x")
    left = F.expr("CASE x WHEN 0 THEN concat(o_orderkey, '|0|1:') WHEN 1 THEN cast(o_orderkey AS string) END").alias("a")
    right = F.expr("CASE x WHEN 0 THEN '' WHEN 1 THEN '|0|1:' ELSE concat(o_orderkey, '-') END").alias("b")
    rows = orders.select("o_orderkey", shape).select("o_orderkey", left, right, (F.col("o_orderkey") + F.col("x") / 1000).alias("d"))
    digested = rows.select((F.col("o_orderkey") % 10).alias("bucket"), row_digest(rows.schema, ["a", "b", "d"]).alias("digest"))
    return digested.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("digest").alias("digests"))


@query("SELECT event_id, 'half' AS \"column\" FROM events WHERE event_id % 2 = 1")
def not_null_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("half"), "event_type")
    return transform.null_rows(rows, ["half", "event_type"], ["event_id"])


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return transform.duplicates(table(spark, sf_dir, "customer"), ["c_nationkey"])


# Changes -------------------------------------------------------------------------------------------------------------


@query(LAST_SQL)
def changes_last_op(spark, sf_dir):
    return ch.last_op(events(spark, sf_dir), ["c_custkey"])


_RUNS = """WITH o AS (SELECT event_id AS seq, event_type = 'error' AS d, lag(event_type = 'error') OVER (ORDER BY event_id) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> d THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS run_id FROM o),
w AS (SELECT CAST(run_id AS BIGINT) AS run_id, any_value(d) AS is_delete, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM r GROUP BY run_id)"""


@query(f"{_RUNS} SELECT * FROM w")
def changes_queue_runs(spark, sf_dir):
    return ch.runs(events(spark, sf_dir))


@query(f"{_RUNS} SELECT run_id, i AS part, is_delete, first_seq + i * 3 AS first_seq, least(first_seq + i * 3 + 2, last_seq) AS last_seq, least(first_seq + i * 3 + 2, last_seq) - (first_seq + i * 3) + 1 AS n FROM w, range(0, 100000) x(i) WHERE i <= (n - 1) // 3")
def changes_queue_batches(spark, sf_dir):
    return ch.runs(events(spark, sf_dir), most=3)


@query("SELECT event_id AS seq, user_id AS c_custkey, event_type = 'error' AS is_delete FROM events WHERE user_id < 60")
def changes_below_watermark(spark, sf_dir):
    return ch.below_watermark(events(spark, sf_dir), "c_custkey", 60).select("seq", "c_custkey", "is_delete")


@query(APPLIED_SQL)
def changes_apply_upsert_delete(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return _cents(ch.apply_changes(stale(customer), customer, events(spark, sf_dir), ["c_custkey"]))


@query("""SELECT c_custkey, c_name, c_nationkey, CAST(round((c_acctbal - 1) * 100) AS BIGINT) AS cents FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""")
def changes_late_reread(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return _cents(ch.refresh_keys(stale(customer), customer, events(spark, sf_dir), ["c_custkey"]))


@query("""WITH e AS (SELECT event_id, event_type, user_id AS o, CASE WHEN event_type = 'signup' THEN (user_id + 1) % 150 ELSE user_id END AS k FROM events),
p AS (SELECT o AS k, true AS d, event_id FROM e WHERE o <> k UNION ALL SELECT k, CASE WHEN o <> k THEN false ELSE event_type = 'error' END, event_id FROM e)
SELECT k, arg_max(d, event_id) AS is_delete, max(event_id) AS seq FROM p GROUP BY k""")
def changes_apply_pk_update(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    moved = e.select(F.col("event_id").alias("seq"), F.expr("event_type = 'error'").alias("is_delete"), F.col("user_id").alias("old_key"), F.expr("CASE WHEN event_type = 'signup' THEN (user_id + 1) % 150 ELSE user_id END").alias("k"))
    return ch.last_op(ch.split_updates(moved, "k"), ["k"])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return feed.stream_feed(spark, f"{sf_dir}/events.parquet", schema, "event_id", "user_id", "event_type = 'error'").withColumnRenamed("key", "c_custkey")


@query(APPLIED_SQL)
def changes_stream_apply(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    store = Store(spark, scratch(spark))
    store.swap(store.write(stale(customer)))
    apply_stream(_stream(spark, sf_dir), store, lambda: table(spark, sf_dir, "customer"), ["c_custkey"], f"{store.base}/stream")
    return _cents(store.read())


@query(LAST_SQL)
def changes_stateful_stream(spark, sf_dir):
    store = Store(spark, scratch(spark))
    return stateful_last_op(_stream(spark, sf_dir), store, "c_custkey", f"{store.base}/stream")


@query("SELECT count(DISTINCT user_id) AS pending FROM events")
def pending_delta_count(spark, sf_dir):
    return ch.last_op(events(spark, sf_dir), ["c_custkey"]).agg(F.count(F.lit(1)).alias("pending"))


@query("WITH r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rn FROM (SELECT DISTINCT user_id FROM events)) SELECT CAST((rn - 1) // 40 AS BIGINT) AS batch_id, count(*) AS n_keys, min(user_id) AS first_key FROM r GROUP BY 1")
def flush_batches(spark, sf_dir):
    keys = ck.numbered(ch.last_op(events(spark, sf_dir), ["c_custkey"]), ["c_custkey"])
    return keys.groupBy(F.floor((F.col("rn") - 1) / 40).cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_keys"), F.min("c_custkey").alias("first_key"))


@query("SELECT max(event_id) AS position, min(event_id) <= 1 AS from_start, max(event_id) < 5 OR min(event_id) <= 6 AS from_five FROM events")
def current_position(spark, sf_dir):
    e = events(spark, sf_dir)
    return spark.createDataFrame([(feed.current_position(e), feed.position_available(e, 0), feed.position_available(e, 5))], "position long, from_start boolean, from_five boolean")


@query("SELECT CAST(run_id AS BIGINT) AS run_id, any_value(d) AS is_delete, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> d THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS run_id FROM (SELECT event_id * 10 + event_id % 7 AS seq, event_type = 'error' AS d, lag(event_type = 'error') OVER (ORDER BY event_id) AS p FROM events)) GROUP BY run_id")
def changes_queue_runs_sparse(spark, sf_dir):
    """Positions with gaps, as a log's are."""
    return ch.runs(events(spark, sf_dir).withColumn("seq", F.col("seq") * 10 + F.col("seq") % 7))


@query("""WITH last AS (SELECT user_id % 50 AS k, max(event_id) AS seq FROM events GROUP BY 1),
back AS (SELECT c_custkey, c_name, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY seq DESC) AS r FROM customer JOIN last ON c_custkey = k),
new AS (SELECT c_custkey, c_name, c_nationkey FROM back WHERE r = 1)
SELECT * FROM new UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM last) AND c_nationkey NOT IN (SELECT c_nationkey FROM new)""")
def changes_apply_unique(spark, sf_dir):
    """Rows that come back displace those that clash with them on another unique index, as REPLACE does."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    changed = events(spark, sf_dir).select("seq", (F.col("c_custkey") % 50).alias("c_custkey"), F.lit(False).alias("is_delete"))
    return ch.apply_changes(customer, customer, changed, ["c_custkey"], unique=[["c_nationkey"]])


# Watermarks, feedback, progress --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), n AS (SELECT lo, least(CAST(ceil((hi - lo) / 1000.0) AS BIGINT), 4) AS n FROM s)
SELECT CAST(lo + (n - 1) * 1000 AS BIGINT) AS lower, CAST(lo + n * 1000 AS BIGINT) AS upper, 5000 < lo + n * 1000 AS passed FROM n""")
def low_watermark(spark, sf_dir):
    """Chunks finish out of order and the sixth not at all: the mark stays at the fifth, or at the last that has an end."""
    low, high = ck.key_stats(table(spark, sf_dir, "orders"), "o_orderkey").select("min_key", "max_key").first()
    chunker = Chunker("o_orderkey", low, high, target_s=1e9)
    for i, chunk in sorted(enumerate(chunker), key=lambda x: (x[0] * 7 % 11, x[0])):
        if i != 5 and chunk.upper:
            chunker.feedback(chunk, 0.01)
    mark = Chunk.from_json(chunker.low_watermark())
    return spark.createDataFrame([(mark.lower.values[0], mark.upper.values[0], 5000 < mark.upper.values[0])], "lower long, upper long, passed boolean")


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM events) SELECT value AS p90 FROM r WHERE rn = n // 10 + 1")
def p90_chunk_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((-F.col("value")).alias("v"), (-F.col("event_id")).alias("i"))
    n = rows.agg((F.floor(F.count(F.lit(1)) / 10) + 1).alias("at"))
    return ck.numbered(rows, ["v", "i"]).join(F.broadcast(n), F.col("rn") == F.col("at")).select((-F.col("v")).alias("p90"))


@query("SELECT * FROM (VALUES (1, 5000), (2, 500), (3, 5)) t(step, batch_size)")
def batch_size_feedback(spark, sf_dir):
    control, rows = BatchControl(), []
    for step, seconds in enumerate((0.1, 1.0, 100.0), 1):
        for _ in range(10):
            control.feedback(1000, seconds)
        rows.append((step, control.size))
    return spark.createDataFrame(rows, "step int, batch_size int")


@query("SELECT * FROM (VALUES (1, 100), (2, 10), (3, 15)) t(step, chunk_size)")
def chunk_size_feedback(spark, sf_dir):
    control, rows = SizeControl(), []
    for step, times in enumerate(([1.0], [1.0], [0.01] * 11), 1):
        for s in times:
            control.feedback(control.size, s)
        rows.append((step, control.size))
    return spark.createDataFrame(rows, "step int, chunk_size int")


@query("""WITH p AS (SELECT c_nationkey, count(*) AS expected, count(*) FILTER (c_acctbal > 0) AS copied FROM customer GROUP BY 1), s AS (SELECT *, CAST(floor((expected - copied) / 0.01) AS BIGINT) AS s FROM p)
SELECT c_nationkey, expected, copied, round(copied / expected, 6) AS progress, CASE WHEN copied / expected > 0.9999 THEN 'DUE' WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's'
WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS eta FROM s""")
def copy_progress_eta(spark, sf_dir):
    """One small row a nation, as one a table; the texts are the driver's."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("c_acctbal") > 0).alias("copied"))
    rows = [(k, n, c, round(backfill.progress(c, n), 6), backfill.eta(c, n, 0.01, 100)) for k, n, c in per.collect()]
    return spark.createDataFrame(rows, per.schema.add("progress", "double").add("eta", "string"))


@query("""WITH top AS (SELECT max(event_id) AS newest FROM events), workers AS (SELECT event_type AS channel, max(event_id) AS applied, max(CASE WHEN value > 0 THEN event_id END) AS queued FROM events GROUP BY 1),
conns AS (SELECT DISTINCT event_type AS channel FROM events WHERE user_id < 100), a AS (SELECT max(newest - applied) AS lag FROM workers JOIN conns USING (channel), top), q AS (SELECT max(coalesce(applied - queued, 0)) AS lag FROM workers JOIN conns USING (channel))
SELECT greatest(a.lag, q.lag) AS lag FROM a, q""")
def lag_estimate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    workers = e.groupBy(F.col("event_type").alias("channel")).agg(F.max("event_id").alias("applied"), F.max(F.when(F.col("value") > 0, F.col("event_id"))).alias("queued"))
    conns = e.where("user_id < 100").select(F.col("event_type").alias("channel")).distinct()
    return metrics.replica_lag(e.agg(F.max("event_id").alias("newest")), workers, conns)


@query("SELECT event_type AS channel, CAST(floor(epoch_us((SELECT max(ts) FROM events)) / 1000000) - floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS seconds, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events GROUP BY 1")
def lag_seconds(spark, sf_dir):
    """Seconds that each channel is behind the newest one, and days that it spans."""
    e = table(spark, sf_dir, "events")
    return metrics.seconds_behind(e.select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("at")))


@query("SELECT event_id AS position, user_id AS rows_copied, event_type AS statement FROM events ORDER BY event_id DESC LIMIT 1")
def latest_checkpoint(spark, sf_dir):
    """Three checkpoints are written; the newest is read back."""
    store = Store(spark, scratch(spark))
    for e in sorted(table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(3).collect(), key=lambda e: e.event_id):
        store.save_checkpoint(
            copier_watermark="", checksum_watermark="", position=e.event_id, rows_copied=e.user_id, rows_copied_logical=e.user_id, statement=e.event_type, parts={})
    got = store.load_checkpoint()
    return spark.createDataFrame([(got["position"], got["rows_copied"], got["statement"])], "position long, rows_copied long, statement string")


@query("SELECT n_nationkey, substr('warehouse_of_long_names', 1, 20) || '.' || substr(n_name, 1, 32) || '-' || substr(sha1('warehouse_of_long_names.' || n_name), 1, 8) AS lock_name FROM nation")
def lock_name(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame([(k, store_lock_name("warehouse_of_long_names", n)) for k, n in nations.collect()], nations.schema.fields[0].simpleString().replace(":", " ") + ", lock_name string")


# Schema and statements -----------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus')) t(ordinal, column_name)")
def column_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = _new_orders(orders)
    return spark.createDataFrame(list(enumerate(transform.shared_columns(orders.columns, new.schema.names, new.generated), 1)), "ordinal int, column_name string")


@query("SELECT * FROM (VALUES ('half_key', 'added'), ('note', 'added'), ('region', 'added'), ('o_custkey', 'bigint to string'), ('o_totalprice', 'dropped'), ('o_orderdate', 'dropped'), ('o_orderpriority', 'dropped')) t(column_name, change)")
def schema_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (orders.schema, _new_orders(orders).schema))
    rows = [(c, "dropped" if c not in new else "added" if c not in old else f"{old[c]} to {new[c]}") for c in sorted(old.keys() | new.keys()) if old.get(c) != new.get(c)]
    return spark.createDataFrame(rows, "column_name string, change string")


@query("SELECT * FROM (VALUES ('by_date', 'o_orderdate,o_custkey,o_orderkey'), ('by_customer', 'o_custkey,o_orderkey'), ('whole', 'o_orderkey,o_custkey')) t(index_name, chunk_key)")
def index_key_merge(spark, sf_dir):
    indexes = {"by_date": ("o_orderdate",), "by_customer": ("o_custkey", "o_orderkey"), "whole": ("o_orderkey",)}
    t = TableDef("orders", table(spark, sf_dir, "orders").schema, ("o_custkey", "o_orderkey"), indexes=indexes)
    return spark.createDataFrame([(i, ",".join(t.index_key(i))) for i in t.indexes], "index_name string, chunk_key string")


@query("SELECT * FROM (VALUES ('labels', 'arithmetic'), ('orders', 'arithmetic'), ('sparse', 'quantile'), ('generated', 'arithmetic'), ('text', 'quantile'), ('two', 'quantile')) t(name, strategy)")
def chunk_strategy(spark, sf_dir):
    orders, labels = table(spark, sf_dir, "orders"), table(spark, sf_dir, "labels")
    sparse = orders.select((F.col("o_orderkey") * 50).alias("k"), F.col("o_orderkey").cast("string").alias("t"))
    found = [("labels", ck.strategy(labels, ["doc_id"])), ("orders", ck.strategy(orders, ["o_orderkey"])), ("sparse", ck.strategy(sparse, ["k"])), ("generated", ck.strategy(sparse, ["k"], True)),
             ("text", ck.strategy(sparse, ["t"])), ("two", ck.strategy(orders, ["o_custkey", "o_orderkey"]))]
    return spark.createDataFrame(found, "name string, strategy string")


STATEMENTS = [
    "ALTER TABLE t DROP INDEX b", "ALTER TABLE t ADD INDEX (a, b)", "ALTER TABLE t DROP INDEX b, ADD COLUMN c INT", "CREATE UNIQUE INDEX u ON s.t (a)", "ALTER TABLE t ENGINE=InnoDB",
    "ALTER TABLE t RENAME INDEX a TO b, DROP INDEX c", "ALTER TABLE t ALTER INDEX b INVISIBLE", "DROP TABLE t", "ALTER TABLE t ADD PARTITION (PARTITION p VALUES LESS THAN (10))",
]


@query("""SELECT * FROM (VALUES (0, 'alter', true, false), (1, 'alter', false, false), (2, 'alter', false, false), (3, 'alter', false, true), (4, 'alter', false, false),
(5, 'alter', true, false), (6, 'alter', true, false), (7, 'drop', false, false), (8, 'alter', true, false)) t(n, kind, metadata_only, adds_unique)""")
def statement_classes(spark, sf_dir):
    parsed = [parse(s) for s in STATEMENTS]
    return spark.createDataFrame([(i, p.kind, metadata_only(p), adds_unique(p)) for i, p in enumerate(parsed)], "n int, kind string, metadata_only boolean, adds_unique boolean")


REFUSED = [
    ("ALTER TABLE t DROP PRIMARY KEY", "primary_key"), ("ALTER TABLE t RENAME TO u", "rename"), ("ALTER TABLE t RENAME COLUMN a TO b", "rename"), ("ALTER TABLE t CHANGE a b INT", "rename"),
    ("ALTER TABLE t ADD COLUMN a INT, ALGORITHM=INPLACE", "illegal_clause"), ("ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES u (a)", "foreign_keys"),
    ("ALTER TABLE t DROP COLUMN a, ADD COLUMN a INT", "drop_add"), ("ALTER TABLE t ALTER INDEX a INVISIBLE, ADD COLUMN c INT", "index_visibility"), ("ALTER TABLE t CHANGE a a BIGINT", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{why}')" for i, (_, why) in enumerate(REFUSED)) + ") t(n, refused_by)")
def preflight_checks(spark, sf_dir):
    def refused(sql: str) -> str:
        try:
            checks.run("preflight", checks.Resources(parse(sql)))
            return ""
        except checks.CheckFailed as e:
            return str(e).split(":")[0]

    return spark.createDataFrame([(i, refused(s)) for i, (s, _) in enumerate(REFUSED)], "n int, refused_by string")


# The whole state machine ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'new' AS tier FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type = 'error', event_id) AS d FROM events GROUP BY 1) WHERE d)")
def migration_end_to_end(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").drop("c_acctbal")
    store = Store(spark, scratch(spark))
    store.swap(store.write(customer))
    gone = ch.last_op(events(spark, sf_dir), ["c_custkey"]).where("is_delete").select("c_custkey")

    def live() -> DataFrame:  # the source as its owner has left it meanwhile
        return backfill.delete_keys(customer, gone, ["c_custkey"])

    def pending(position: int) -> DataFrame:
        return events(spark, sf_dir).where(F.col("seq") > position).withColumnRenamed("c_custkey", "key").select("seq", "key", "is_delete")

    t = TableDef("customer", customer.schema, ("c_custkey",))
    sql = "ALTER TABLE customer ADD COLUMN tier VARCHAR(10) NOT NULL DEFAULT 'new', MODIFY c_nationkey BIGINT, DROP COLUMN c_mktsegment"
    Migration(store, t, sql, pending, live, chunk_size=50_000).run()
    return store.read().select("c_custkey", "c_name", "c_nationkey", "tier")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, 'new' AS note FROM lineitem")
def migration_four_part_key(spark, sf_dir):
    """A key of four columns: quantile chunks, copied, compared and swapped."""
    lineitem = table(spark, sf_dir, "lineitem")
    store = Store(spark, scratch(spark))
    store.swap(store.write(lineitem))
    Migration(store, TableDef("lineitem", lineitem.schema, tuple(FOUR)), "ALTER TABLE lineitem ADD COLUMN note VARCHAR(10) DEFAULT 'new', DROP COLUMN l_tax").run()
    return store.read().select(*FOUR, F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "note")


@query("SELECT 'orders-' || o_orderkey AS name, o_custkey FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT 'orders-' || o_orderkey, -1 FROM orders WHERE o_orderkey % 10 = 3 AND o_orderkey % 20 <> 3")
def migration_text_key(spark, sf_dir):
    """A text key, with changes that arrive during the copy: some rows change, some go."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders-"), "o_orderkey").alias("name"), "o_custkey", "o_orderkey")
    store = Store(spark, scratch(spark))
    store.swap(store.write(orders.drop("o_orderkey")))
    gone, changed = F.col("o_orderkey") % 20 == 3, F.col("o_orderkey") % 10 == 3
    after = orders.where(~gone).select("name", F.when(changed, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("o_custkey"))
    log = orders.where(changed).select(F.col("o_orderkey").alias("seq"), F.col("name").alias("key"), gone.alias("is_delete"))
    new = TableDef("orders", store.read().schema, ("name",))
    Migration(store, new, "ALTER TABLE orders MODIFY o_custkey BIGINT NOT NULL, ADD INDEX c (o_custkey)", lambda p: log.where(F.col("seq") > p), lambda: after, chunk_size=5000, flush_s=0).run()
    return store.read()

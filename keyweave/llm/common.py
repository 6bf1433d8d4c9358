"""What several training-data operators share: shared-folder storage, even joins, bounded pre-filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key that holds more than one row in HEAVY is looked up by broadcast; there are fewer than HEAVY of them.
HEAVY = 1024
#: Bits of the fixed-size candidate bitmap (rows of 32 bits each, so at most 2**17 broadcast rows).
BITMAP_BITS = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is unset, the warehouse takes its place, which is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/keyweave-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: lineage ends in files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has (names differ by more than case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that are not named like any of names, whatever the case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared path that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def even_lookup(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """left LEFT JOIN right on `on`, even where one key holds a third of left's rows.

    `right` is unique on `on`; `weight` is the count of left's rows for its key and `total` the sum of the
    weights. Keys heavier than total / HEAVY, of which there are fewer than HEAVY, are looked up by broadcast.
    Their rows then carry a key spread over all partitions through the shuffle join, which finds the rest.
    `weight` stays in the result; all other columns of right are nullable there.
    """
    values = [c for c in right.columns if c not in on]
    bar = max(1, total // HEAVY)
    heavy = right.where(F.col(weight) > bar).select(*[F.col(c).alias(f"_h_{c}") for c in right.columns])
    rest = right.where(F.col(weight) <= bar).select(*[F.col(c).alias(f"_r_{c}") for c in right.columns], F.lit(False).alias("_r_spread"))
    marked = left.join(F.broadcast(heavy), [F.col(c) == F.col(f"_h_{c}") for c in on], "left")
    found = F.col(f"_h_{weight}").isNotNull()
    # A heavy row's first key column is replaced by a row-wise hash so that it can go to any partition; the flag keeps it from matching.
    first = dict(left.dtypes)[on[0]]
    spread = F.xxhash64(*[F.col(c) for c in left.columns]).cast(first)
    marked = marked.withColumn("_spread", found).withColumn("_k0", F.when(found, spread).otherwise(F.col(on[0])))
    cond = [F.col("_k0") == F.col(f"_r_{on[0]}"), F.col("_spread") == F.col("_r_spread"), *[F.col(c) == F.col(f"_r_{c}") for c in on[1:]]]
    out = marked.join(rest, cond, "left")
    return out.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in values])


def prefiltered(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key may be in wanted (one column of keys), by a broadcast bitmap of fixed size.

    No wanted row is lost; some others may stay. The bitmap has BITMAP_BITS bits at most whatever the input, so at
    sizes that fill it the filter only stops helping. An exact join follows it everywhere it is used.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITMAP_BITS))
    name = wanted.columns[0]
    bits = wanted.select(slot(name).alias("s")).groupBy(F.shiftright("s", 5).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("s"), F.lit(32)).cast("int"))).alias("_bits"))
    marked = df.withColumn("_slot", slot(key)).withColumn("_w", F.shiftright("_slot", 5))
    hit = F.getbit(F.col("_bits"), F.pmod(F.col("_slot"), F.lit(32)).cast("int")) == 1
    return marked.join(F.broadcast(bits), F.col("_w") == F.col("_word")).where(hit).select(*df.columns)

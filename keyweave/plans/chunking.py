"""Chunk plans as DataFrames: arithmetic ranges of a dense key, quantile ranges of any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from keyweave.sources.store import scratch


def key_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, min_key, max_key (0 where the table is empty)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.min(key), F.lit(0)).alias("min_key"), F.coalesce(F.max(key), F.lit(0)).alias("max_key"))


def arithmetic_plan(df: DataFrame, key: str, size: int) -> DataFrame:
    """(chunk_id, lower, upper): below the minimum, then [p, p + size) until p reaches the maximum, then an open end.

    The key's minimum and maximum are read first; the chunks are then made where they are needed, none on the driver.
    """
    low, high = key_stats(df, key).select("min_key", "max_key").first()
    n = -(-(high - low) // size)
    at = F.lit(low).cast("long") + (F.col("id") - 1) * size
    upper = F.when(F.col("id") <= n, at + size)
    return df.sparkSession.range(n + 2).select(F.col("id").alias("chunk_id"), F.when(F.col("id") > 0, at).cast("long").alias("lower"), upper.cast("long").alias("upper"))


def arithmetic_chunk(key: str, low: Column, size: int) -> Column:
    """Chunk of a key in arithmetic_plan, without a join. Keys beyond the last boundary are in the open chunk anyway."""
    return F.greatest(F.floor((F.col(key) - low) / size).cast("long") + 1, F.lit(0).cast("long"))


def ranged(df: DataFrame, key: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Key (and further) columns with `_p`, the number of the key range that a row lies in, and `_m`, ascending in key order
    inside a range from _p << 33 on.

    The ranges come from a sample, which each evaluation would draw anew; so the rows are written once to the shared
    folder, and whatever reads them sees the same ranges.
    """
    names = list(dict.fromkeys([*key, *columns]))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.select(*names).repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_m", F.monotonically_increasing_id())
    at = at.withColumn("_p", F.shiftrightunsigned("_m", 33))
    path = scratch(df.sparkSession)
    at.write.parquet(path)
    return df.sparkSession.read.schema(at.schema).parquet(path)


def with_previous(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key columns and `columns`, `previous`, a struct of `columns` of the row before in key order (null for the first),
    and the key range `_p`.

    Neighbours are found inside key ranges; the first row of a range meets the last one of the range before, a table
    of one row per range. The key must be unique.
    """
    at = ranged(df, key, columns)
    last = at.groupBy("_p").agg(F.max_by(F.struct(*columns), "_m").alias("_last"))
    before = last.select(F.col("_p").alias("_q"), F.lag("_last").over(Window.orderBy("_p")).alias("_before"))
    inside = at.withColumn("_inside", F.lag(F.struct(*columns)).over(Window.partitionBy("_p").orderBy("_m")))
    joined = inside.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return joined.select(*[c for c in at.columns if c not in ("_p", "_m")], F.coalesce("_inside", "_before").alias("previous"), "_p")


def numbered(df: DataFrame, key: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Key (and further) columns with `rn`, the 1-based position in key order over the whole table.

    Rows are ranged and sorted by the key; a row's number is its place in its range plus the rows of the ranges before,
    a table of one row per range. No task sees all rows, as a global window would make it.
    """
    names = list(dict.fromkeys([*key, *columns]))
    at = ranged(df, key, columns)
    counts = at.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_p").alias("_q"), before.alias("_before"))
    joined = at.join(F.broadcast(counts), F.col("_p") == F.col("_q"))
    return joined.select(*names, (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rn"))


def quantile_plan(df: DataFrame, key: Sequence[str], size: int, where: str | None = None) -> DataFrame:
    """(chunk_id, lower_<c>..., upper_<c>...) with boundaries at every (size + 1)-th row; the last side is open.

    The first chunk has size rows, later full ones size + 1 (the row at the lower boundary and size more). A table
    of at most size rows is one chunk without bounds. The key must be unique.
    """
    rows = numbered(df.where(where) if where else df, key)
    bounds = rows.where(F.col("rn") % (size + 1) == 0).select((F.col("rn") / (size + 1)).cast("long").alias("chunk_id"), *key)
    spark = df.sparkSession
    lower = bounds.select("chunk_id", *[F.col(c).alias(f"lower_{c}") for c in key])
    lower = spark.range(1).select(F.lit(0).cast("long").alias("chunk_id"), *[F.lit(None).cast(dict(lower.dtypes)[f"lower_{c}"]).alias(f"lower_{c}") for c in key]).union(lower)
    upper = bounds.select((F.col("chunk_id") - 1).alias("chunk_id"), *[F.col(c).alias(f"upper_{c}") for c in key])
    return lower.join(upper, "chunk_id", "left")


def quantile_chunk(df: DataFrame, key: Sequence[str], size: int, columns: Sequence[str] = ()) -> DataFrame:
    """Rows with the chunk_id that quantile_plan gives them, by position instead of a range join."""
    return numbered(df, key, columns).withColumn("chunk_id", F.floor(F.col("rn") / (size + 1)).cast("long")).drop("rn")


def gaps(df: DataFrame, key: str, width: int) -> DataFrame:
    """Key gaps wider than `width`: (gap_start, gap_end) as last key before and first key behind."""
    pairs = with_previous(df, [key], [key]).select(F.col(f"previous.{key}").alias("gap_start"), F.col(key).alias("gap_end"))
    return pairs.where(F.col("gap_end") - F.col("gap_start") > width)


def strategy(df: DataFrame, key: Sequence[str], auto_increment: bool = False) -> str:
    """How to cut a table into chunks: `arithmetic` where its key is one integer without wide gaps, else `quantile`.

    A generated key counts as dense. Any other integer key is, if its values span at most four times the rows.
    """
    kind = df.schema[key[0]].dataType
    if len(key) > 1 or not isinstance(kind, T.IntegralType):
        return "quantile"
    n, low, high = key_stats(df, key[0]).first()
    return "arithmetic" if auto_increment and high - low <= 64 * n or high - low < 4 * max(n, 1) else "quantile"

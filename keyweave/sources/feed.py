"""Change feeds: batch and streaming reads of (seq, key, is_delete)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def schema_fingerprint(df: DataFrame) -> str:
    """Names and types in order; a run compares it at every phase, as a schema that drifts is fatal."""
    return df.schema.simpleString()


def as_changes(df: DataFrame, seq: str, key: str, is_delete: str) -> DataFrame:
    return df.select(F.col(seq).alias("seq"), F.col(key).alias("key"), F.expr(is_delete).alias("is_delete"))


def read_feed(spark: SparkSession, path: str, seq: str, key: str, is_delete: str) -> DataFrame:
    return as_changes(spark.read.parquet(path), seq, key, is_delete)


def stream_feed(spark: SparkSession, path: str, schema: StructType, seq: str, key: str, is_delete: str) -> DataFrame:
    """New files of a table's folder as a stream, or its one file; the schema is given, never inferred."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        stream, path = stream.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return as_changes(stream.parquet(path), seq, key, is_delete)


def current_position(feed: DataFrame) -> int | None:
    """The newest position of a feed; None if it is empty."""
    return feed.agg(F.max("seq")).first()[0]


class NullKey(ValueError):
    """A change names no row."""


def pending(feed: DataFrame) -> tuple[int, int | None]:
    """(changes, newest position) of what a feed holds; a change without a key is an error."""
    n, top, named = feed.agg(F.count(F.lit(1)), F.max("seq"), F.count("key")).first()
    if named < n:
        raise NullKey(f"{n - named} of {n} changes have no key")
    return n, top


def position_available(feed: DataFrame, position: int) -> bool:
    """Whether the feed still holds everything behind a saved position."""
    low = feed.agg(F.min("seq")).first()[0]
    return low is not None and low <= position + 1

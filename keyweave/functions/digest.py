"""Row and chunk digests that do not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from keyweave.functions.predicates import named


def canonical(col: str, kind: T.DataType, compat: bool = False) -> Column:
    """A column's text form for digests, one for each value: the shortest text that reads back as the same double, too.

    compat drops fractions of a second by rounding, as the checksum casts do.
    """
    c = named(col)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(F.date_trunc("second", c + F.expr("interval 500 milliseconds")) if compat else c, "yyyy-MM-dd HH:mm:ss" if compat else "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(F.regexp_replace(c.cast("string"), "\\x00+$", "").cast("binary")) if compat else F.hex(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def row_text(schema: T.StructType, columns: Sequence[str], compat: bool = False) -> Column:
    """Every column's form behind its length, or a dash for null: rows with other values have another text."""
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = []
    for c in columns:
        form = canonical(c, kinds[c], compat)
        parts.append(F.coalesce(F.concat(F.length(form).cast("string"), F.lit(":"), form), F.lit("-")))
    return F.concat(*parts)


def row_digest(schema: T.StructType, columns: Sequence[str], compat: bool = False) -> Column:
    """compat: CRC-32, which is linear under XOR (swaps between rows cancel). Else 60 bits of MD5."""
    text = row_text(schema, columns, compat)
    return F.crc32(text.cast("binary")) if compat else F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def checksum(df: DataFrame, columns: Sequence[str], by: Sequence[str | Column] = (), compat: bool = False) -> DataFrame:
    """Rows and XOR of row digests, by group; an empty table has 0 and 0. Partial aggregation runs before the shuffle."""
    digested = df.select(*[named(c) if isinstance(c, str) else c for c in by], row_digest(df.schema, columns, compat).alias("_d"))
    names = [c if isinstance(c, str) else digested.columns[i] for i, c in enumerate(by)]
    return digested.groupBy(*[named(c) for c in names]).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("_d"), F.lit(0).cast("bigint")).alias("digest"))

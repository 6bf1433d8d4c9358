"""Schema evolution as a projection, and reports of rows that it would damage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from keyweave.functions.predicates import named
from keyweave.model import TableDef


def shared_columns(source: Sequence[str], target: Sequence[str], generated: Sequence[str] = ()) -> list[str]:
    """Stored columns of both, in the source's order."""
    there = set(target) - set(generated)
    return [c for c in source if c in there]


def project(df: DataFrame, target: TableDef, renamed: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """df in the target's shape: shared columns cast, new ones by default or null, generated ones recomputed.

    Casts that fail give null here; lossy_rows reports them. Columns that only the source has are dropped, but for those
    named in keep, which come last.
    """
    back = {new: old for old, new in (renamed or {}).items()}
    have = dict(df.dtypes)
    out = []
    for f in target.schema.fields:
        if f.name in target.generated:
            continue
        old = back.get(f.name, f.name)
        value = named(old).try_cast(f.dataType) if old in have else F.lit(target.defaults.get(f.name)).cast(f.dataType)
        out.append(value.alias(f.name))
    made = df.select(*out, *keep)
    for name, expr in target.generated.items():
        made = made.withColumn(name, F.expr(expr).cast(target.schema[name].dataType))
    return made.select(*[named(c) for c in target.schema.names], *keep)


def is_lossy(col: str, old: T.DataType, new: T.DataType, longest: int | None = None) -> Column:
    """Whether a value's cast is null, does not cast back to the value, or is longer than `longest` characters.

    Texts need not cast back character by character (007 is 7), but a number that they hold must be the cast's.
    """
    c = named(col)
    there = c.try_cast(new)
    bad = there.isNull()
    if isinstance(old, T.StringType):
        if isinstance(new, T.NumericType):
            bad = bad | ~there.try_cast("double").eqNullSafe(c.try_cast("double"))
        if isinstance(new, T.DecimalType):
            bad = bad | ~there.cast("decimal(38,18)").eqNullSafe(c.try_cast("decimal(38,18)"))
    else:
        bad = bad | ~there.try_cast(old).eqNullSafe(c)
    if longest is not None:
        bad = bad | (F.length(there.cast("string")) > longest)
    return c.isNotNull() & bad


def lossy_rows(df: DataFrame, casts: dict[str, T.DataType], keep: Sequence[str], longest: dict[str, int] | None = None) -> DataFrame:
    """(keep..., column, value) of every value that a cast would lose, round or cut, in one scan."""
    have, longest = {f.name: f.dataType for f in df.schema.fields}, longest or {}
    bad = [F.when(is_lossy(c, have[c], k, longest.get(c)), F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value"))) for c, k in casts.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*bad))).alias("b")).select(*keep, "b.column", "b.value")


def null_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., column) of nulls in columns that must not have any."""
    bad = F.array_compact(F.array(*[F.when(named(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(*keep, F.explode(bad).alias("column"))


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns..., n) of values that would violate a unique index; nulls never do."""
    some = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    return some.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class UnsafeConversion(Exception):
    """Values would be lost."""


def assert_safe(df: DataFrame, target: TableDef, unique: Sequence[Sequence[str]] = ()) -> None:
    """Raise if a copy of df into target would lose, null or clash; looks for one example of each, not for all."""
    have = dict(df.dtypes)
    casts = {f.name: f.dataType for f in target.schema.fields if f.name in have and (have[f.name] != f.dataType.simpleString() or f.name in target.longest)}
    if casts and (bad := lossy_rows(df, casts, target.key, target.longest).first()):
        raise UnsafeConversion(f"column {bad['column']}: {bad['value']!r} does not fit")
    firm = [f.name for f in target.schema.fields if not f.nullable and f.name in have]
    if firm and (bad := null_rows(df, firm, target.key).first()):
        raise UnsafeConversion(f"column {bad['column']} has nulls")
    for columns in unique:
        if bad := duplicates(df, columns).first():
            raise UnsafeConversion(f"duplicate {columns}: {bad.asDict()}")

"""Key predicates in a form that reaches the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _value(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def lexicographic(cols: Sequence[str | Column], values: Sequence, op: str) -> Column:
    """(c1, c2, ...) op (v1, v2, ...) as ORs of ANDs: comparisons of structs are not pushed down, these are.

    Only the last column takes the operator itself; where an earlier one decides, it decides strictly.
    """
    if op not in (">", ">=", "<", "<=") or len(cols) != len(values) or not cols:
        raise ValueError(f"no comparison {op!r} of {len(cols)} columns and {len(values)} values")
    cols = [named(c) if isinstance(c, str) else c for c in cols]
    strict = op[0]
    compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
    out = compare[op](cols[-1], _value(values[-1]))
    for c, v in reversed(list(zip(cols[:-1], values[:-1], strict=True))):
        out = compare[strict](c, _value(v)) | ((c == _value(v)) & out)
    # A bound on the first column alone is implied and lets row groups be skipped at once.
    return out if len(cols) == 1 else compare[strict + "="](cols[0], _value(values[0])) & out

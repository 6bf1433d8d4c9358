"""Tables, key values, boundaries and chunks."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

from keyweave.functions.predicates import lexicographic

INT_MIN, INT_MAX, UINT_MAX = -(2**63), 2**63 - 1, 2**64 - 1


def saturating_add(value: int, delta: int, unsigned: bool = False) -> int:
    """Key arithmetic that stops at the type's limits (ANSI mode would raise instead)."""
    low, high = (0, UINT_MAX) if unsigned else (INT_MIN, INT_MAX)
    return max(low, min(high, value + delta))


@dataclass(frozen=True)
class TableDef:
    """What Spark's schema lacks: the key, generated columns and their expressions, defaults, secondary indexes."""

    name: str
    schema: StructType
    key: tuple[str, ...]
    generated: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    auto_increment: bool = False
    #: Names of indexes without duplicates, and the most characters of text columns that have a limit.
    unique: frozenset[str] = frozenset()
    longest: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        missing = [c for c in self.key if c not in self.schema.names]
        if not self.key or missing:
            raise ValueError(f"table {self.name} needs a key of its own columns, not {missing or 'none'}")

    @property
    def stored_columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.generated]

    def index_key(self, index: str) -> tuple[str, ...]:
        """Columns of an index, then the key columns that it lacks."""
        cols = self.indexes[index]
        return cols + tuple(c for c in self.key if c not in cols)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "schema": json.loads(self.schema.json()), "key": self.key, "generated": self.generated, "defaults": self.defaults,
                           "indexes": self.indexes, "auto_increment": self.auto_increment, "unique": sorted(self.unique), "longest": self.longest}, default=str)

    @staticmethod
    def from_json(text: str) -> TableDef:
        d = json.loads(text)
        return TableDef(**d | {"schema": StructType.fromJson(d["schema"]), "key": tuple(d["key"]), "unique": frozenset(d["unique"]),
                               "indexes": {k: tuple(v) for k, v in d["indexes"].items()}})


@dataclass(frozen=True)
class Bound:
    values: tuple
    inclusive: bool = True

    def same_place(self, other: Bound | None) -> bool:
        """Whether both stand at the same key values, on whichever side."""
        return other is not None and self.values == other.values


#: Kinds of key values that JSON lacks.
_KINDS = {"datetime": datetime, "date": date, "decimal": Decimal}


def _pack(v: object) -> object:
    if isinstance(v, (bytes, bytearray)):
        return {"bytes": base64.b64encode(bytes(v)).decode()}
    if v is None or isinstance(v, (str, int, float, bool)):
        return v
    kind = next((k for k, t in _KINDS.items() if type(v) is t), "text")
    return {kind: v.isoformat() if kind in ("datetime", "date") else str(v)}


def _unpack(v: object) -> object:
    if not isinstance(v, dict):
        return v
    (kind, text), = v.items()
    if kind == "bytes":
        return base64.b64decode(text)
    return _KINDS[kind].fromisoformat(text) if kind in ("datetime", "date") else _KINDS.get(kind, str)(text)


@dataclass(frozen=True)
class Chunk:
    """A key range: either side may be open; extra is a further SQL condition that belongs to the chunk."""

    key: tuple[str, ...]
    lower: Bound | None = None
    upper: Bound | None = None
    size: int = 0
    extra: str | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.lower:
            out = out & lexicographic(self.key, self.lower.values, ">=" if self.lower.inclusive else ">")
        if self.upper:
            out = out & lexicographic(self.key, self.upper.values, "<=" if self.upper.inclusive else "<")
        return out & F.expr(self.extra) if self.extra else out

    def to_json(self) -> str:
        side = lambda b: b and {"values": [_pack(v) for v in b.values], "inclusive": b.inclusive}
        return json.dumps({"key": self.key, "size": self.size, "extra": self.extra, "lower": side(self.lower), "upper": side(self.upper)})

    @staticmethod
    def from_json(text: str) -> Chunk:
        d = json.loads(text)
        side = lambda b: b and Bound(tuple(_unpack(v) for v in b["values"]), b["inclusive"])
        return Chunk(tuple(d["key"]), side(d["lower"]), side(d["upper"]), d["size"], d["extra"])

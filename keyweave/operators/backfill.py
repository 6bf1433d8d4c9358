"""Insert-if-absent, replace and delete as algebra over immutable tables, and copy progress."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Progress beyond which the copy is due; seconds before a rate is believed; hours of history.
DUE, LEARN_S, HISTORY_H = 0.9999, 60, 24


def insert_absent(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """target plus the rows whose key it lacks; running it twice changes nothing."""
    return target.unionByName(rows.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def replace_keys(target: DataFrame, source: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `keys` as the source has them now: a key that left the source leaves the target."""
    rest = target.join(keys.select(*key), list(key), "left_anti")
    return rest.unionByName(source.join(keys.select(*key), list(key), "left_semi").select(*target.columns))


def delete_keys(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key), list(key), "left_anti")


def delete_range(target: DataFrame, inside: Column) -> DataFrame:
    """Rows that are not surely inside; a null comparison is outside."""
    return target.where(~F.coalesce(inside, F.lit(False)))


def replace_range(target: DataFrame, source: DataFrame, inside: Column) -> DataFrame:
    return delete_range(target, inside).unionByName(source.where(inside).select(*target.columns))


def last_per_unique(rows: DataFrame, unique: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows that clash on a unique key the one with the greatest order stays, as REPLACE leaves it.

    max_by folds on the map side, so a hot key does not gather its rows. Rows with a null in the key never clash.
    """
    some = " and ".join(f"`{c}` is not null" for c in unique)
    row = F.struct(*rows.columns)
    kept = rows.where(some).groupBy(*unique).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    return kept.unionByName(rows.where(f"not ({some})"))


def progress(copied: int, expected: int) -> float:
    """Share done, 0 to 1; an estimate of no rows counts as done."""
    return 1.0 if expected <= 0 else min(1.0, copied / expected)


def eta(copied: int, expected: int, rate: float, elapsed_s: float) -> str:
    """Remaining time as text: DUE near the end, TBD before a rate is known."""
    if progress(copied, expected) > DUE:
        return "DUE"
    if rate <= 0 or elapsed_s < LEARN_S:
        return "TBD"
    return clock(math.floor((expected - copied) / rate))


def clock(seconds: int) -> str:
    parts = [(seconds // 3600, "h"), (seconds % 3600 // 60, "m"), (seconds % 60, "s")]
    shown = [f"{n}{u}" for n, u in parts]
    return "".join(shown[next((i for i, (n, _) in enumerate(parts) if n), 2) :])


@dataclass
class EtaHistory:
    """One estimate (as a due time) an hour, and how far the newest one has drifted from the oldest."""

    kept: list[tuple[float, float]] = field(default_factory=list)

    def add(self, now_s: float, remaining_s: float) -> None:
        if self.kept and now_s - self.kept[-1][0] < 3600:
            return
        self.kept = [x for x in [*self.kept, (now_s, now_s + remaining_s)] if now_s - x[0] < HISTORY_H * 3600]

    def drift(self, now_s: float, remaining_s: float) -> str:
        if not self.kept:
            return ""
        at, due = self.kept[0]
        moved = round((now_s + remaining_s - due) / 60)
        return f"{moved:+d}m from {round((now_s - at) / 3600)}h ago"

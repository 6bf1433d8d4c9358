"""Preflight checks by scope."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from keyweave.model import TableDef
from keyweave.plans.ddl import Statement

#: When a check runs.
SCOPES = ("prerun", "preflight", "post_setup", "cutover", "post_cutover", "testing")


class CheckFailed(ValueError):
    """A migration may not go on."""


@dataclass
class Resources:
    statement: Statement | None = None
    table: TableDef | None = None
    threads: int = 4
    target_chunk_s: float = 0.5
    max_lag_s: float = 120
    spark_version: str = "4"
    change_columns: tuple[str, ...] = ("seq", "key", "is_delete")
    foreign_keys: bool = False
    writable: Callable[[], bool] = lambda: True
    lock_held: Callable[[], bool] = lambda: True
    drifted: Callable[[], bool] = lambda: False
    lag: Callable[[], float] | None = None
    extra: dict = field(default_factory=dict)


_CHECKS: dict[str, list[tuple[str, Callable[[Resources], None]]]] = {s: [] for s in SCOPES}


def check(scope: str):
    def add(f):
        _CHECKS[scope].append((f.__name__, f))
        return f

    return add


def run(scope: str, r: Resources) -> list[str]:
    """Run a scope's checks in the order they were registered; the first failure raises."""
    for name, f in _CHECKS[scope]:
        try:
            f(r)
        except CheckFailed as e:
            raise CheckFailed(f"{name}: {e}") from None
    return [name for name, _ in _CHECKS[scope]]


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise CheckFailed(why)


def _kinds(r: Resources) -> set[str]:
    return {c.kind for c in r.statement.clauses} if r.statement else set()


@check("prerun")
def version(r: Resources) -> None:
    _need(int(re.match(r"\d+", r.spark_version)[0]) >= 4, "Spark 4 or later is needed")


@check("prerun")
def settings(r: Resources) -> None:
    _need(1 <= r.threads <= 64, "threads must be 1 to 64")
    _need(0.1 <= r.target_chunk_s <= 5, "target chunk time must be 100 ms to 5 s")
    _need(10 <= r.max_lag_s <= 4 * 3600, "maximal lag must be 10 s to 4 h")


@check("preflight")
def configuration(r: Resources) -> None:
    _need({"seq", "key", "is_delete"} <= set(r.change_columns), "the change feed needs seq, key and is_delete")


@check("preflight")
def table_name(r: Resources) -> None:
    _need(r.table is None or 1 <= len(r.table.name) <= 56, "table name must have 1 to 56 characters, so that its companions fit 64")


@check("preflight")
def drop_add(r: Resources) -> None:
    named = Counter(c.name for c in r.statement.clauses if c.kind in ("drop_column", "add_column")) if r.statement else {}
    _need(all(n == 1 for n in named.values()), "a column is named twice among ADD and DROP")


@check("preflight")
def foreign_keys(r: Resources) -> None:
    _need("add_foreign" not in _kinds(r) and not r.foreign_keys, "foreign keys are not supported")


@check("preflight")
def illegal_clause(r: Resources) -> None:
    _need(not _kinds(r) & {"algorithm", "lock"}, "ALGORITHM and LOCK are not allowed")


@check("preflight")
def primary_key(r: Resources) -> None:
    _need("drop_primary" not in _kinds(r), "the primary key cannot be dropped")


@check("preflight")
def rename(r: Resources) -> None:
    _need(not _kinds(r) & {"rename_table", "rename_column"}, "renames are not supported")
    _need(not any(c.kind == "change" and c.name != c.new_name for c in (r.statement.clauses if r.statement else ())), "CHANGE may not rename")


@check("preflight")
def index_visibility(r: Resources) -> None:
    mixed = "index_visibility" in _kinds(r) and len(_kinds(r)) > 1
    _need(not mixed, "index visibility cannot be changed along with a copy")


@check("preflight")
def privileges(r: Resources) -> None:
    _need(r.writable(), "the table's folder cannot be written")


@check("preflight")
@check("post_setup")
def replica_health(r: Resources) -> None:
    """Where a replica's lag is watched, it must answer with a number; one that doesn't replicate has none."""
    if r.lag is None:
        return
    try:
        seconds = r.lag()
    except Exception as e:
        raise CheckFailed(f"the replica's lag cannot be read: {e}") from e
    _need(seconds is not None and seconds >= 0, "the replica does not replicate")


@check("cutover")
def lock(r: Resources) -> None:
    _need(r.lock_held(), "another run has taken the table's lock")


@check("post_setup")
@check("cutover")
def drift(r: Resources) -> None:
    _need(not r.drifted(), "the source's schema changed during the run")

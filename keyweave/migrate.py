"""The migration state machine: copy a table under a new schema, follow its changes, prove equality, swap."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from keyweave import checks
from keyweave.metrics import NoopSink, NoThrottle, Progress, Sink, Throttle, chunk_metrics, report, wait_open
from keyweave.functions.predicates import lexicographic, named
from keyweave.model import Bound, Chunk, TableDef
from keyweave.operators.backfill import EtaHistory, eta, progress
from keyweave.operators.changes import TRIVIAL, apply_changes
from keyweave.operators.diff import TablesDiffer, diff_chunks
from keyweave.operators.transform import assert_safe, project, shared_columns
from keyweave.plans.chunking import key_stats, quantile_plan, strategy
from keyweave.plans.ddl import adds_unique, evolve, metadata_only, parse
from keyweave.sources.feed import pending, schema_fingerprint
from keyweave.sources.store import Store


class State(IntEnum):
    """In order: later states compare greater."""

    INITIAL = 0
    COPY_ROWS = 1
    WAIT_SENTINEL = 2
    APPLY_CHANGES = 3
    ANALYZE = 4
    CHECKSUM = 5
    POST_CHECKSUM = 6
    CUT_OVER = 7
    CLOSED = 8
    FAILED = 9


class SchemaDrift(RuntimeError):
    """The source's schema changed during the run."""


def statement_text(statement: str = "", table: str = "", alter: str = "") -> str:
    """The statement to run: given whole, or as a table and its ALTER clauses; never both."""
    if bool(statement) == bool(table or alter) or bool(table) != bool(alter):
        raise ValueError("give a statement, or a table and its alter clauses")
    return statement or f"ALTER TABLE `{table}` {alter.strip()}"


def pass_through(spark: SparkSession, sql: str) -> DataFrame:
    """CREATE, DROP and RENAME TABLE run as they are in the session's catalog; an ALTER is none of them."""
    found = parse(sql)
    if found.kind == "alter":
        raise ValueError("an ALTER is migrated")
    if found.kind == "rename":
        old, new = re.split(r"\s+TO\s+", re.sub(r"(?i)^\s*RENAME\s+TABLE\s+", "", found.text), flags=re.I)
        return spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    return spark.sql(found.text)


#: Chunks of a copy at most (each is one folder, so a large table has large ones), jobs of a copy at most, chunks that one
#: comparison takes, passes of the comparison, seconds between flushes, and looks at the feed before a barrier is given up.
#: A job of the copy or the comparison may have to read the whole source, so their numbers are bounded, too.
MOST_CHUNKS, COPIES, COMPARED, PASSES, FLUSH_S, BARRIER_WAITS = 256, 16, 64, 3, 30.0, 60


def chunk_plan(df: DataFrame, table: TableDef, size: int) -> list[Chunk]:
    """Chunks of about `size` rows that cover every key: by arithmetic where the key is dense, else by quantiles.

    There are MOST_CHUNKS at most; in larger tables they are larger.
    """
    key = table.key
    if strategy(df, key, table.auto_increment) == "arithmetic":
        n, low, high = key_stats(df, key[0]).first()
        step = max(size, -(-(high - low + 1) // MOST_CHUNKS))
        at = [(low + i * step,) for i in range(1, -(-(high - low + 1) // step))]
    else:
        step = max(size, -(-df.count() // MOST_CHUNKS))
        bounds = quantile_plan(df, key, step).where("chunk_id > 0").orderBy("chunk_id").select(*[f"lower_{c}" for c in key]).collect()
        at = [tuple(b) for b in bounds]
    edges = [None, *at, None]
    return [Chunk(key, a and Bound(a), b and Bound(b, False), step) for a, b in zip(edges, edges[1:])]


def chunk_number(chunks: list[Chunk]) -> Column:
    """The number of the chunk that a row's key lies in, by bisection: a row meets few bounds of many.

    Where the first column of a key tells, it alone is looked at, in little code, which the JVM can compile. Only rows whose
    first value is one of the bounds' are told apart by all columns; that code is interpreted.
    """
    bounds = [c.lower.values for c in chunks[1:]]

    def among(low: int, high: int, above: Callable[[int], Column], leaf: Callable[[int], Column]) -> Column:
        if low == high:
            return leaf(low)
        at = (low + high) // 2
        return F.when(above(at), among(at + 1, high, above, leaf)).otherwise(among(low, at, above, leaf))

    key = chunks[0].key
    exact = among(0, len(bounds), lambda i: lexicographic(key, bounds[i], ">="), F.lit)
    if len(key) == 1 or not bounds:
        return exact
    firsts = list(dict.fromkeys(b[0] for b in bounds))
    behind = [sum(b[0] in firsts[:n] for b in bounds) for n in range(len(firsts) + 1)]
    rough = among(0, len(firsts), lambda i: named(key[0]) > F.lit(firsts[i]), lambda n: F.lit(behind[n]))
    met = named(key[0]).isin([F.lit(v) for v in firsts])
    return F.when(met, F.transform(F.array(F.lit(0)), lambda _: exact)[0]).otherwise(rough)


@dataclass
class Migration:
    """One ALTER of a stored table.

    Chunks are copied into a folder each; a manifest of these folders is the new version. One job copies a chunk, or
    several neighbours where there are more than COPIES, and `threads` jobs run at a time. A checkpoint lists the finished ones, so a resumed run copies the others only. Between rounds of chunks
    changes are flushed into finished chunks, whose folders alone are rewritten. Chunks not begun read the source as it
    is when they begin, so changes of their keys need no replay.

    `changes` gives (seq, key, is_delete) behind a position, key being a struct where the table's key has several
    columns; `live` is the source as its owner has it now, where that is not the version the copy began with; within
    `blocked` the owner makes no change, and `source_position` tells the position that the feed must have reached then.
    """

    store: Store
    table: TableDef
    sql: str
    changes: Callable[[int], DataFrame] | None = None
    live: Callable[[], DataFrame] | None = None
    blocked: Callable[[], AbstractContextManager] = nullcontext
    source_position: Callable[[], int] | None = None
    chunk_size: int = 100_000
    target_chunk_s: float = 0.5
    threads: int = 4
    flush_s: float = FLUSH_S
    checksum: bool = True
    fix: bool = True
    strict: bool = False
    defer_cutover: bool = False
    sentinel_polls: int = 0
    sink: Sink = field(default_factory=NoopSink)
    throttle: Throttle = field(default_factory=NoThrottle)
    keep_old: bool = False
    state: State = State.INITIAL
    copied: int = 0
    position: int = -1
    started: float = field(default_factory=time.monotonic)

    def run(self) -> str:
        """Returns how it was done: metadata or copy."""
        resources = checks.Resources(
            table=self.table, threads=self.threads, target_chunk_s=self.target_chunk_s, spark_version=self.store.spark.version, writable=self.store.writable,
            change_columns=tuple(self.changes(self.position).columns) if self.changes else checks.Resources.change_columns, lock_held=self.store.held, drifted=self._drifted, lag=getattr(self.throttle, "lag", None),
            max_lag_s=getattr(self.throttle, "limit_s", checks.Resources.max_lag_s))
        checks.run("prerun", resources)
        self.resources, self.statement = resources, parse(self.sql)
        resources.statement = self.statement
        if self.statement.kind != "alter":
            raise ValueError("only ALTER is migrated; run other statements as they are")
        self.store.lock(self.statement.schema, self.table.name)
        try:
            if metadata_only(self.statement):
                self.new_table = evolve(self.table, self.statement)
                self.store.define(self.new_table)
                self.state = State.CLOSED
                return "metadata"
            checks.run("preflight", resources)
            self._copy_path()
            return "copy"
        except BaseException:
            self.state = State.FAILED
            raise
        finally:
            self.store.unlock()

    def _copy_path(self) -> None:
        self.new_table = evolve(self.table, self.statement)
        self.schema = StructType([self.new_table.schema[c] for c in self.new_table.schema.names])
        self.source_name = self.store.current()
        self.source = self.store.read(self.source_name)
        self.print = schema_fingerprint(self.source)
        assert_safe(self.source, self.new_table, [c.columns for c in self.statement.clauses if c.kind == "add_unique"])
        self._resume()
        checks.run("post_setup", self.resources)
        self._copy()
        self._gate()
        self.state = State.APPLY_CHANGES
        self._drain()
        self.state = State.ANALYZE
        key = self.table.key[0]
        self.stats = self._target().agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).cast("string").alias("min_key"), F.max(key).cast("string").alias("max_key")).first().asDict()
        self.store.files.write("STATS", json.dumps(self.stats))
        if self.checksum or adds_unique(self.statement) or self.resumed:
            self.state = State.CHECKSUM
            self._compare()
        self.state = State.POST_CHECKSUM
        self._drain()
        self.state = State.CUT_OVER
        with self.blocked():
            self._barrier()
            self._drain(all_of_it=True)
            try:
                checks.run("cutover", self.resources)
            except checks.CheckFailed as e:
                raise (SchemaDrift(self.table.name) if self._drifted() else e) from None
            old = self.store.swap(self.store.write_manifest(self.schema, self.parts))
            self.store.define(self.new_table)
        checks.run("post_cutover", self.resources)
        if not self.keep_old and old:
            self.store.drop(old)
        self._sweep()
        self.store.clear_checkpoints()
        self.state = State.CLOSED

    def _sweep(self) -> None:
        """Remove folders of the new version that its manifest doesn't list."""
        kept = {f.split("/")[1] for f in self.parts.values()}
        for name in set(self.store.files.names(self.shadow)) - kept:
            self.store.files.delete(f"{self.shadow}/{name}")

    def _drifted(self) -> bool:
        return hasattr(self, "print") and schema_fingerprint(self._source_now()) != self.print

    def _source_now(self) -> DataFrame:
        return self.live() if self.live else self.store.read(self.source_name)

    def _target(self, which: list[int] | None = None) -> DataFrame:
        return self.store.read_parts(self.schema, [f for i, f in sorted(self.parts.items()) if which is None or i in which])

    def _resume(self) -> None:
        """Go on from the checkpoint, or plan anew; strict mode refuses to plan anew for another ALTER."""
        saved = self.store.load_checkpoint()
        if saved and saved["statement"] != self.statement.text and self.strict:
            raise ValueError("the checkpoint belongs to another ALTER")
        self.resumed = bool(saved) and saved["statement"] == self.statement.text and saved["parts"]["source"] == self.source_name
        self.compared = 0
        if self.resumed:
            p = saved["parts"]
            self.shadow, self.done, self.flushes = p["shadow"], set(p["done"]), p["flushes"]
            self.chunks, self.parts = [Chunk.from_json(c) for c in p["chunks"]], {int(i): f for i, f in p["folders"].items()}
            self.position, self.copied = saved["position"], saved["rows_copied"]
            self.compared = int(saved["checksum_watermark"] or 0)
            self._sweep()  # what a killed run left half done
            return
        if saved:
            self.store.files.delete(saved["parts"]["shadow"])
            self.store.clear_checkpoints()
        self.shadow, self.done, self.flushes, self.parts = f"_new_{self.table.name}-{time.time_ns()}", set(), 0, {}
        self.chunks = chunk_plan(self.source, self.table, self.chunk_size)

    def _save(self) -> None:
        low = next((i for i in range(len(self.chunks)) if i not in self.done), len(self.chunks))
        parts = {"source": self.source_name, "shadow": self.shadow, "chunks": [c.to_json() for c in self.chunks], "done": sorted(self.done), "folders": self.parts, "flushes": self.flushes}
        self.store.save_checkpoint(
            copier_watermark=self.chunks[low - 1].to_json() if low else "", checksum_watermark=str(self.compared or ""), position=self.position, rows_copied=self.copied,
            rows_copied_logical=self.copied, statement=self.statement.text, parts=parts)

    def _copy_chunk(self, i: int) -> tuple[int, float]:
        """(rows, seconds) of one chunk, copied from the source as it is now."""
        wait_open(self.throttle)
        began, seen = time.monotonic(), Observation(f"copy{uuid.uuid4().hex}")
        rows = project(self._source_now().where(self.chunks[i].predicate()), self.new_table)
        folder = f"{self.shadow}/chunk{i:05d}-{uuid.uuid4().hex[:8]}"
        self.store.write(rows.observe(seen, F.count(F.lit(1)).alias("n")), folder)
        n, seconds = seen.get["n"], time.monotonic() - began
        self.parts[i] = folder
        report(self.sink, chunk_metrics(seconds, self.chunks[i].size, n))
        return n, seconds

    def _inside(self, which: list[int]) -> Column:
        """Keys from the first to the last of the chunks."""
        return Chunk(self.table.key, self.chunks[which[0]].lower, self.chunks[which[-1]].upper).predicate()

    def _copy_group(self, which: list[int]) -> tuple[int, float]:
        """(rows, seconds) of neighbouring chunks, which one job copies from one read of the source."""
        if len(which) == 1:
            return self._copy_chunk(which[0])
        wait_open(self.throttle)
        began, seen = time.monotonic(), Observation(f"copy{uuid.uuid4().hex}")
        number = F.lit(which[0]) + chunk_number([self.chunks[i] for i in which])
        rows = project(self._source_now().where(self._inside(which)).withColumn("_chunk", number), self.new_table, keep=["_chunk"])
        folder = f"{self.shadow}/chunk{which[0]:05d}-{uuid.uuid4().hex[:8]}"
        found = self.store.write_parts(rows.observe(seen, F.count(F.lit(1)).alias("n")), "_chunk", folder)
        n, seconds = seen.get["n"], time.monotonic() - began
        self.parts.update(found)
        report(self.sink, chunk_metrics(seconds, sum(self.chunks[i].size for i in which), n))
        return n, seconds

    def _copy(self) -> None:
        self.state = State.COPY_ROWS
        self.expected = self.source.count()
        self.history, self.rates = EtaHistory(), [(time.monotonic(), self.copied)]
        todo = [i for i in range(len(self.chunks)) if i not in self.done]
        each, groups = -(-len(self.chunks) // COPIES), []
        for i in todo:
            if i % each and groups and groups[-1][-1] == i - 1:
                groups[-1].append(i)
            else:
                groups.append([i])
        flushed = time.monotonic()
        with ThreadPoolExecutor(self.threads) as pool:
            for at in range(0, len(groups), self.threads):
                now = groups[at : at + self.threads]
                self.copied += sum(n for n, _ in pool.map(self._copy_group, now))
                self.done.update(i for which in now for i in which)
                self.rates = [*self.rates[-1:], (time.monotonic(), self.copied)]
                if self.changes and time.monotonic() - flushed >= self.flush_s:
                    self._flush()
                    flushed = time.monotonic()
                self._save()

    def _gate(self) -> None:
        """While the sentinel exists the cut-over waits; it is made here if the caller defers."""
        if self.defer_cutover:
            self.store.files.create("SENTINEL")
        self.state = State.WAIT_SENTINEL
        for _ in range(self.sentinel_polls):
            if not self.store.files.exists("SENTINEL"):
                return
            if self.changes:
                self._flush()
            time.sleep(1)
        if self.store.files.exists("SENTINEL"):
            raise TimeoutError("the sentinel is still there")

    def _flush(self) -> int:
        """Apply the changes behind the position to finished chunks; returns how many changes there were."""
        batch = self.changes(self.position)
        n, top = pending(batch)
        if not n:
            return 0
        key = self.table.key
        names = ["key"] if len(key) == 1 else [f"key.`{c}`" for c in key]
        number = chunk_number(self.chunks)
        changed = batch.select("seq", *[F.col(c).alias(k) for c, k in zip(names, key, strict=True)], "is_delete").withColumn("_chunk", number)
        touched = sorted({r[0] for r in changed.select("_chunk").distinct().collect()} & self.done)
        if touched:
            unique = [self.new_table.indexes[u] for u in sorted(self.new_table.unique)]
            which = sorted(self.done) if unique else touched  # a row may displace one of any chunk
            source = self._source_now().where(self._inside(touched))
            if len(touched) <= 16:
                source = source.where(reduce(lambda a, b: a | b, [self.chunks[i].predicate() for i in touched]))
            mine = changed.where(F.col("_chunk").isin(touched)).drop("_chunk")
            after = apply_changes(self._target(which), project(source, self.new_table), mine, key, unique=unique)
            fresh = self.store.write_parts(after.withColumn("_chunk", number), "_chunk", f"{self.shadow}/flush{self.flushes:05d}-{uuid.uuid4().hex[:8]}")
            old = [self.parts.pop(i) for i in which if i in self.parts]
            self.parts.update(fresh)
            self.flushes += 1
        self.position = top
        self._save()
        if touched:
            for folder in old:
                self.store.files.delete(folder)
        return n

    def _drain(self, all_of_it: bool = False) -> None:
        """Flush until what comes is trivial, or until nothing comes."""
        while self.changes and self._flush() >= (1 if all_of_it else TRIVIAL):
            pass

    def _barrier(self) -> None:
        """Wait until the feed has what the owner had written when it was blocked."""
        if not self.changes or not self.source_position:
            return
        goal = self.source_position()
        for _ in range(BARRIER_WAITS):
            self._flush()
            if self.position >= goal:
                return
            time.sleep(1)
        raise TimeoutError(f"the feed has not reached {goal}")

    def _compare(self) -> None:
        """Compare source and target, COMPARED chunks at a time, and copy again what differs; sets `passes`.

        Finished groups are in the checkpoint, so that a resumed run goes on behind them.
        """
        columns = shared_columns(self.new_table.stored_columns, self.table.stored_columns)
        self.passes = 1
        for at in range(self.compared, len(self.chunks), COMPARED):
            which = list(range(at, min(at + COMPARED, len(self.chunks))))
            number = F.lit(at) + chunk_number([self.chunks[i] for i in which])
            for n in range(1, PASSES + 1):
                wanted = project(self._source_now().where(self._inside(which)), self.new_table)
                bad = [r[0] for r in diff_chunks(wanted, self._target(which), columns, number).where("not same").select("chunk_id").collect()]
                self.passes = max(self.passes, n)
                if not bad:
                    break
                if not self.fix:
                    raise TablesDiffer(f"{len(bad)} chunks differ")
                for i in bad:
                    self._copy_chunk(i)
            else:
                raise TablesDiffer(f"differences after {PASSES} passes")
            self.compared = which[-1] + 1
            self._save()

    def rate(self) -> float:
        """Rows a second of the last round of chunks."""
        (t0, n0), (t1, n1) = self.rates[0], self.rates[-1]
        return (n1 - n0) / max(t1 - t0, 1e-9)

    def status(self) -> Progress:
        expected, now = getattr(self, "expected", 0), time.monotonic()
        rate = self.rate() if hasattr(self, "rates") else 0.0
        left, moved = eta(self.copied, expected, rate, now - self.started), ""
        if rate > 0 and hasattr(self, "history"):
            seconds = max(expected - self.copied, 0) / rate
            moved = self.history.drift(now, seconds)
            self.history.add(now, seconds)
        return Progress(self.state.name, " ".join(x for x in (f"{progress(self.copied, expected):.2%}", left, moved) if x), self.copied, expected)

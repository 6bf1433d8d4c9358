"""Streaming change application: exactly once into versions, and keyed state across batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from keyweave.operators.changes import apply_changes, last_op
from keyweave.sources.store import Files, Store


def batch_name(spark, checkpoint: str, batch_id: int) -> str:
    """A version's name that tells the stream (the id that its checkpoint has for good) and the batch."""
    stream = json.loads(Files(spark, checkpoint).read("metadata"))["id"]
    return f"stream-{stream}-{batch_id:010d}"


def _drain(changes: DataFrame, store: Store, checkpoint: str, version: Callable[[DataFrame], DataFrame]) -> None:
    """Each micro-batch makes one version from the current one. A batch that is replayed finds its own version, or a
    later one of its stream, current and does nothing; batches of other streams don't count."""

    def one(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(store.spark, checkpoint, batch_id)
        now = store.current() if store.files.exists("CURRENT") else ""
        if now.startswith(name[:-10]) and now >= name:
            return
        store.write(version(batch), name)
        store.swap(name)

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_stream(changes: DataFrame, store: Store, source: Callable[[], DataFrame], key: Sequence[str], checkpoint: str, keep: Callable[[DataFrame], DataFrame] = lambda c: c) -> None:
    """Drain a change stream into the store's current version, each batch once.

    Whatever was pending at the start is drained before this returns.
    """
    _drain(changes, store, checkpoint, lambda batch: apply_changes(store.read(), source(), keep(batch), key))


def stateful_last_op(changes: DataFrame, store: Store, key: str, checkpoint: str) -> DataFrame:
    """(key, is_delete, seq) of each key's last change in all batches so far; the store holds them as versions.

    A batch is folded on the map side and then merged with the state, so a hot key is one row of either. An empty
    stream gives none; a second run on the same checkpoint gives what there was before, and what came since.
    """
    columns = [key, "is_delete", "seq"]
    empty = changes.sparkSession.createDataFrame([], changes.select(*columns).schema)
    state = lambda: store.read().select(*columns) if store.files.exists("CURRENT") else empty
    _drain(changes, store, checkpoint, lambda batch: last_op(state().unionByName(last_op(batch, [key]).select(*columns)), [key]).select(*columns))
    return state()

"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyweave.llm.common import shared_dir, stored
from keyweave.llm.tokens import library_encoder

#: Tokens of a sequence; pieces balanced together in one task (a group's rows are dealt by hash, so its size is even).
CAPACITY, GROUP_PIECES = 2048, 1 << 15
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, feed-forward and attention work.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def balance(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece.

    Pieces go in descending order of length to the sequence of lowest cost that still has room. As many sequences
    as the tokens need at least are open from the start; one more opens where a piece fits in none. Sequences wait
    in one heap for each remaining room, and a tree over rooms gives the cheapest of those with enough.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    leaves = 1 << capacity.bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    none = (float("inf"), -1)
    tree = [none] * (2 * leaves)
    filled: list[int] = [0] * count

    def refresh(room: int) -> None:
        i = leaves + room
        tree[i] = heaps[room][0] if heaps[room] else none
        while i > 1:
            i >>= 1
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best

    heaps[capacity] = [(0.0, s) for s in range(count)]
    refresh(capacity)
    seq, offset = [0] * len(lengths), [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[at]
        lo, hi, best = leaves + need, leaves + capacity + 1, none
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo, hi = lo >> 1, hi >> 1
        cost, s = best
        if s < 0:
            s, cost = len(filled), 0.0
            filled.append(0)
        else:
            room = capacity - filled[s]
            heapq.heappop(heaps[room])
            refresh(room)
        seq[at], offset[at] = s, filled[s]
        filled[s] += need
        room = capacity - filled[s]
        heapq.heappush(heaps[room], (cost + LINEAR * need + QUADRATIC * need * need, s))
        refresh(room)
    return seq, offset


_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt")])


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), library_encoder(path).encode((t.as_py() for t in batch.column(1)), end_id), strict=True):
                n = len(ids)
                for start in range(0, n, capacity):
                    rows.append((doc, start, min(capacity, n - start), zlib.crc32(ids[start : start + capacity]), n, at))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, schema=_PIECES)

    return run


def _group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "salt"], kind="stable", na_position="first").reset_index(drop=True)
        seq, offset = balance(group["length"].tolist(), capacity)
        return group.assign(sequence_id=group["g"].to_numpy() * (1 << 32) + np.array(seq, np.int64), offset=np.array(offset, np.int64))[
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids (null: empty) and end_id, cut at multiples of capacity, so only its last piece is
    short. Pieces are written to the shared folder (texts never shuffle), dealt by hash into groups of about
    GROUP_PIECES, and each group is balanced by itself; ids are group << 32 + number. Offsets leave no gap.
    Rows that repeat an id are documents of their own; null ids are kept; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, end_id, capacity), ", ".join(f"{f.name} long" for f in _PIECES))
    pieces = stored(pieces, f"{shared_dir(spark)}/pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(_group(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Token ids on disk: Simple-8b words with escapes and per-block offsets, in files of one shard a row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyweave.llm.common import shared_dir
from keyweave.llm.tokens import library_encoder

#: Selector -> (values in a word, bits of each), the word's low 60 bits filled from below. Selector 15 is an escape:
#: the next word holds one value of up to 64 bits.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60))
ESCAPE = 15
#: Values of one independently coded block.
BLOCK = 1024
MAGIC = b"KWS8"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) for unsigned 64-bit values; blocks of BLOCK values step side by side."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    # need[i]: bits of value i. choice[i]: the first (widest-reaching) layout that holds the values from i on.
    # A float's exponent tells the bits; where rounding lifts a value to the next power of two, one too many, which does no harm.
    need = (values.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int16)
    need = np.where(need, need - 1022, 0).astype(np.uint8)
    left = np.minimum(BLOCK - np.arange(n, dtype=np.int32) % BLOCK, n - np.arange(n, dtype=np.int32))
    choice = np.full(n, ESCAPE, np.uint8)
    run = {1: need}  # maximum of need over a window, by doubling

    def most(width: int) -> np.ndarray:
        size = 1
        while size * 2 <= width:
            if size * 2 not in run:
                a = run[size]
                run[size * 2] = np.maximum(a, np.r_[a[size:], np.zeros(min(size, n), np.uint8)][:n])
            size *= 2
        a = run[size]
        rest = width - size
        return a if not rest else np.maximum(a, np.r_[a[rest:], np.zeros(min(rest, n), np.uint8)][:n])

    for selector in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[selector]
        np.putmask(choice, (most(count) <= bits) & (left >= count), selector)
    counts = np.array([c for c, _ in LAYOUT] + [1])
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    picked = []
    live = np.arange(blocks)
    while len(live):
        picked.append(at[live].copy())
        at[live] += counts[choice[at[live]]]
        live = live[at[live] < ends[live]]
    first = np.sort(np.concatenate(picked))
    selector = choice[first]
    wide = selector == ESCAPE
    place = np.cumsum(1 + wide) - (1 + wide)
    words = np.zeros(int(place[-1] + 1 + wide[-1]), np.uint64)
    words[place] = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LAYOUT):
        where = np.flatnonzero(selector == s)
        if bits and len(where):
            packed = np.zeros(len(where), np.uint64)
            for k in range(count):
                packed |= values[first[where] + k] << np.uint64(k * bits)
            words[place[where]] |= packed
    words[place[wide] + 1] = values[first[wide]]
    starts = place[np.searchsorted(first, np.arange(blocks) * BLOCK)]
    return words, starts.astype(np.uint32)


def decode(words: np.ndarray, starts: np.ndarray, n: int, blocks: range | None = None) -> np.ndarray:
    """The n values (or those of some blocks), all words of one selector at a time."""
    if blocks is not None:
        lo, hi = int(starts[blocks.start]), int(starts[blocks.stop]) if blocks.stop < len(starts) else len(words)
        return decode(words[lo:hi], np.zeros(1, np.uint32), min(n, blocks.stop * BLOCK) - blocks.start * BLOCK)
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    # A word behind an escape is raw. Raw words may look like escapes, so runs of them are read in order.
    raw = np.zeros(len(words), bool)
    skip = -1
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if i != skip:
            skip = i + 1
            raw[skip] = True
    at = np.flatnonzero(~raw)
    selector = selector[at]
    counts = np.array([c for c, _ in LAYOUT] + [1])[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        where = np.flatnonzero(selector == s)
        if bits and len(where):
            mask = np.uint64((1 << bits) - 1)
            body = words[at[where]]
            for k in range(count):
                out[first[where] + k] = (body >> np.uint64(k * bits)) & mask
    wide = np.flatnonzero(selector == ESCAPE)
    out[first[wide]] = words[at[wide] + 1]
    return out


def dump(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """One shard: magic, counts, document ids and lengths, per-block offsets, words; all little-endian.

    The last count is `nulls`: so many of the first documents have no id, whatever doc_ids holds for them.
    """
    words, starts = encode(ids)
    head = MAGIC + struct.pack("<QQQQQ", len(doc_ids), len(ids), len(starts), len(words), nulls)
    return head + doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + starts.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def load(shard: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """(document ids, masked where null, lengths, all token ids) of a shard."""
    if shard[:4] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, blocks, words, nulls = struct.unpack_from("<QQQQQ", shard, 4)
    at = 44
    parts = []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u8", words)):
        parts.append(np.frombuffer(shard, kind, count, at))
        at += parts[-1].nbytes
    return np.ma.MaskedArray(parts[0], np.arange(docs) < nulls), parts[1], decode(parts[3].astype(np.uint64), parts[2], n)


#: Ids of one shard, about; a longer document makes a longer shard.
SHARD_IDS = 1 << 18
#: first: ids of the same part before the shard.
_SHARD_DDL = "part int, seq long, first long, n_docs long, n_ids long, payload binary"
_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in held], np.uint64)
            known = np.array([d or 0 for d in docs], np.int64)
            payload = dump(known, lengths, np.concatenate(held), docs.count(None))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "first": [first], "n_docs": [len(docs)], "n_ids": [size], "payload": [payload]}, schema=_SHARDS)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, found in zip(ids, library_encoder(path).encode((t.as_py() for t in batch.column(1)), end_id), strict=True):
                docs.append(doc)
                held.append(found)
                size += len(found)
                if size >= SHARD_IDS:
                    yield flush()
                    docs, held, first, size, seq = [], [], first + size, 0, seq + 1
        if docs:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs, lengths, ids = load(batch.column(1)[i].as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths.astype(np.int64)
            raw = pa.array(ids.astype("<u4").view("<i4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs.data, mask=np.ma.getmaskarray(docs)), pc.add(pa.array(starts), batch.column(0)[i]), pa.array(lengths.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), raw)],
                names=["doc_id", "start", "n_tokens", "ids"])


def _read_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for read in _read(batches):
        yield from _crc(iter([read]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode whole texts (null: empty), append end_id to each, and write shards under path in ascending id order.

    Documents are ranged by id, sorted inside each range and coded there; a file's rows are shards (part, seq) with
    their payload in the Simple-8b format. Equal ids keep all their rows, in text order; null ids come first.
    The files are committed by Spark's writer, so a lost executor leaves no half shard behind.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer, end_id), _SHARD_DDL).write.mode("overwrite").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(first, payload) of the written shards, first counting all ids before the shard.

    A shard knows the ids of its part before it; those of earlier parts are a running sum over the parts' totals
    (one row for each written part, so a table bounded by the partition count, whatever the documents).
    """
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("_p"), before.alias("_before"))
    return shards.join(F.broadcast(parts), F.col("part") == F.col("_p")).select((F.col("_before") + F.col("first")).alias("first"), "payload")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the written documents; start counts all ids before the document."""
    return _placed(spark, path).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids array<int>")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        raw = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8)
        edges = (ids.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_tokens' rows."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """digests(read_tokens(spark, path)), without the ids going through the JVM on the way."""
    return _placed(spark, path).mapInArrow(_read_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def coded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)

"""Proof that two keyed tables are equal: chunk digests first, rows of differing chunks then, and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyweave.functions.digest import checksum, row_digest


def diff_chunks(source: DataFrame, target: DataFrame, columns: Sequence[str], chunk: Column, compat: bool = False) -> DataFrame:
    """(chunk_id, counts and digests of both sides, same): one grouped aggregate a side, then one row a chunk."""
    side = lambda df, s: checksum(df.withColumn("chunk_id", chunk), columns, ["chunk_id"], compat).select("chunk_id", F.col("n_rows").alias(f"{s}_rows"), F.col("digest").alias(f"{s}_digest"))
    both = side(source, "source").join(side(target, "target"), "chunk_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("source_rows", "source_digest", "target_rows", "target_digest")}
    both = both.withColumns(zero)
    return both.withColumn("same", (F.col("source_rows") == F.col("target_rows")) & (F.col("source_digest") == F.col("target_digest")))


def diff_rows(source: DataFrame, target: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, kind, digests): missing_in_target, missing_in_source or mismatch, by one full outer join of digests."""
    side = lambda df, s: df.select(*key, row_digest(df.schema, columns).alias(f"{s}_digest"), F.lit(True).alias(f"_{s}"))
    both = side(source, "source").join(side(target, "target"), list(key), "full_outer")
    kind = F.when(F.col("_target").isNull(), "missing_in_target").when(F.col("_source").isNull(), "missing_in_source").when(F.col("source_digest") != F.col("target_digest"), "mismatch")
    return both.select(*key, kind.alias("kind"), "source_digest", "target_digest").where("kind is not null")


def diff_rows_in_halves(source: DataFrame, target: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The same keys by a left and a right join and UNION, for engines without full outer joins."""
    side = lambda df, s: df.select(*key, row_digest(df.schema, columns).alias(f"{s}_digest"))
    a, b = side(source, "source"), side(target, "target")
    left = a.join(b, list(key), "left").where("target_digest is null or source_digest <> target_digest")
    right = b.join(a, list(key), "left").where("source_digest is null or source_digest <> target_digest")
    return left.select(*key, "source_digest", "target_digest").union(right.select(*key, "source_digest", "target_digest")).distinct()


def repaired(source: DataFrame, target: DataFrame, columns: Sequence[str], chunk: Column, bad: DataFrame | None = None) -> DataFrame:
    """target with every differing chunk (those in `bad`, if it is known) replaced by the source's rows."""
    if bad is None:
        bad = diff_chunks(source, target, columns, chunk).where("not same").select("chunk_id")
    keep = target.withColumn("chunk_id", chunk).join(bad, "chunk_id", "left_anti")
    fresh = source.withColumn("chunk_id", chunk).join(bad, "chunk_id", "left_semi")
    return keep.unionByName(fresh).select(*target.columns)


class TablesDiffer(Exception):
    """Differences remain or may not be repaired."""


def verify(source: DataFrame, target: DataFrame, columns: Sequence[str], chunk: Column, store=None, fix: bool = True, attempts: int = 3) -> tuple[DataFrame, int]:
    """(target, passes): compare and repair until a pass finds nothing; store(df) keeps each repaired version.

    A pass compares once: the ids of its differing chunks are kept for the repair.
    """
    for n in range(1, attempts + 1):
        bad = diff_chunks(source, target, columns, chunk).where("not same").select("chunk_id").persist()
        try:
            found = bad.count()
            if not found:
                return target, n
            if not fix:
                raise TablesDiffer(f"{found} chunks differ")
            fixed = repaired(source, target, columns, chunk, bad)
            target = store(fixed) if store else fixed
        finally:
            if store:
                bad.unpersist()
    raise TablesDiffer(f"differences after {attempts} passes")

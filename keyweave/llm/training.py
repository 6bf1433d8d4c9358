"""Labelled rows for the two quality models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 modulo 3: such rows never teach a model."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality, docs' other columns) of at most `most` labelled rows that are not held out.

    Beyond `most` labelled rows those with the smallest hash of their id teach; the choice does not depend on
    files or order. The sample is small by its bound, so it is broadcast to one scan of docs. Of rows that repeat an
    id one teaches, the least by its columns, so the bound holds for them too. An id with both labels teaches both.
    """
    rows = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    sample = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    docs = docs.drop("quality")
    rest = [c for c in docs.columns if c != "doc_id"]
    found = F.broadcast(sample).join(docs, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*rest)).alias("_row"))
    return found.select("doc_id", "quality", *[F.col("_row")[c].alias(c) for c in rest])

"""Change sets: last operation per key, ordered runs, and their application to a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyweave.operators.backfill import last_per_unique, replace_keys
from keyweave.plans.chunking import with_previous

#: Pending changes below which a drain counts as trivial; changes of one applied batch at first.
TRIVIAL, BATCH = 10_000, 1000


def last_op(changes: DataFrame, key: Sequence[str], seq: str = "seq", delete: str = "is_delete") -> DataFrame:
    """(key, is_delete, seq) of each key's last change. max_by folds before the shuffle, so hot keys stay small."""
    return changes.groupBy(*key).agg(F.max_by(delete, seq).alias("is_delete"), F.max(seq).alias("seq"))


def split_updates(changes: DataFrame, key: str, old_key: str = "old_key", seq: str = "seq") -> DataFrame:
    """An update that moves a row to another key is a delete of the old key and an upsert of the new one."""
    moved = F.col(old_key).isNotNull() & (F.col(old_key) != F.col(key))
    parts = F.when(moved, F.array(F.struct(F.col(old_key).alias("k"), F.lit(True).alias("d")), F.struct(F.col(key).alias("k"), F.lit(False).alias("d"))))
    parts = F.coalesce(parts, F.array(F.struct(F.col(key).alias("k"), F.col("is_delete").alias("d"))))
    return changes.select(seq, F.explode(parts).alias("p")).select(F.col("p.k").alias(key), F.col("p.d").alias("is_delete"), seq)


def below_watermark(changes: DataFrame, key: str, high: Column | int) -> DataFrame:
    """Changes the copy has to hear of: keys that it has not reached yet it will read in their newest state."""
    return changes.where(F.col(key) < high)


def runs(changes: DataFrame, seq: str = "seq", delete: str = "is_delete", most: int | None = None) -> DataFrame:
    """(run_id, is_delete, first_seq, last_seq, n): neighbours of one kind merge, in order; `most` splits long runs.

    seq orders the changes and need not be dense. Runs that start are counted inside ranges of seq and over the ranges
    before, a table of one row per range; no task sees the whole queue.
    """
    at = with_previous(changes, [seq], [delete]).select("_p", seq, delete, (~F.col(f"previous.{delete}").eqNullSafe(F.col(delete))).cast("int").alias("_s"))
    totals = at.groupBy("_p").agg(F.sum("_s").alias("n"))
    prior = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("_p").alias("_q"), prior.alias("_prior"))
    here = Window.partitionBy("_p").orderBy(seq)
    dealt = at.withColumn("_in", F.sum("_s").over(here.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(totals), F.col("_p") == F.col("_q"))
    dealt = dealt.withColumn("run_id", F.col("_prior") + F.col("_in"))
    if most is not None:
        # A run's first change in a range may lie in an earlier range: its place is counted from the run's start.
        sizes = dealt.groupBy("run_id", "_p").agg(F.count(F.lit(1)).alias("_n"))
        ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("run_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("run_id", "_p", ahead.alias("_ahead"))
        inside = F.row_number().over(Window.partitionBy("_p", "run_id").orderBy(seq))
        part = F.floor((F.col("_ahead") + F.col("_i") - 1) / most).cast("long")
        dealt = dealt.withColumn("_i", inside).join(sizes, ["run_id", "_p"]).withColumn("part", part)
    by = ["run_id"] if most is None else ["run_id", "part"]
    return dealt.groupBy(*by).agg(F.first(delete).alias("is_delete"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("n"))


def apply_changes(target: DataFrame, source: DataFrame, changes: DataFrame, key: Sequence[str], seq: str = "seq", unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """target after the changes: changed keys go, those not deleted last come back as the source has them.

    A row that comes back displaces rows that clash with it on one of the `unique` column lists, as REPLACE does; of
    such rows the one that changed last stays.
    """
    last = last_op(changes, key, seq)
    gone = target.join(last.select(*key), list(key), "left_anti")
    back = source.join(last.where("not is_delete").select(*key, F.col("seq").alias("_seq")), list(key)).select(*target.columns, "_seq")
    for columns in unique:
        back = last_per_unique(back, columns, ["_seq"])
        gone = gone.join(back.select(*columns), list(columns), "left_anti")
    return gone.unionByName(back.drop("_seq")).select(*target.columns)


def refresh_keys(target: DataFrame, source: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The late-read form: every changed key takes the source's present row, or none; replays are harmless."""
    return replace_keys(target, source, changes.select(*key).distinct(), key)

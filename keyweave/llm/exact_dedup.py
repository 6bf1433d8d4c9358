"""Exact dedup with an extendible-hash index on shared files, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyweave.llm.common import even_lookup, prefiltered, remove, shared_dir, stored

#: Bits of a key that the directory may look at beyond those that evenly spread keys need; a bucket that is overfull
#: with all of them used stays so, as its keys are alike.
SPARE_BITS = 4
#: Rows that equal texts are folded to, at most, on their way to the owner of their bucket.
SALTS = 8


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a key; a shift by 64 would be one by 0."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(slots: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(slot, bucket, depth) of an extendible-hash directory over slots (slot, n): keys by their first `bits` bits.

    It starts as one bucket of depth 0. A bucket with more than `capacity` keys splits by its next bit, which doubles
    the directory where its depth was the directory's; so a slot's bucket is the widest range around the slot that
    fits, and its number is the range's first slot. The loads of all ranges are one grouped aggregate.
    """
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("range", F.call_function("shiftright", F.col("slot"), F.lit(bits) - F.col("depth")))
    loads = levels.groupBy("depth", "range").agg(F.sum("n").alias("load"))
    fits = levels.join(loads, ["depth", "range"]).where((F.col("load") <= capacity) | (F.col("depth") == bits))
    depth = fits.groupBy("slot").agg(F.min("depth").alias("depth"))
    rest = F.lit(bits) - F.col("depth")
    return depth.select("slot", F.call_function("shiftleft", F.call_function("shiftright", F.col("slot"), rest), rest).alias("bucket"), "depth")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 14, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays.
    1. Keys (a 64-bit hash of each text) are counted; their first bits give the directory, whose overfull buckets split.
    2. Texts whose key occurs once have nothing to be compared with. The others go to the owner of their bucket, equal
       ones of a task and salt folded to one row before. The owner chains the texts of one key: texts in byte order,
       a new link where the bytes differ. keep_id and group_size come from the links, of every salt.
    3. The index (bucket, key, chain, keep_id, group_size) is written to the shared folder with its directory, so a lost
       executor loses nothing of it.
    4. Documents look their link up by key; where a key has several links, by key and bytes. Keys of large groups are
       found by broadcast, all others by a shuffle of keys.
    Rows with a null id count as members; keep_id is null only if all ids of a group are, and such rows all stay.
    Repeated rows (same id and text) all get the same verdict. Other columns are ignored; an empty table gives none.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_key", key(F.col("_text")).cast("long"))
    light = stored(rows.select("_id", "_key", F.sha2("_text", 256).alias("text_sha256")), f"{base}/documents")
    keys = stored(light.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_top")), f"{base}/keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    bits = (n_keys // capacity).bit_length() + SPARE_BITS if n_keys > capacity else 0
    slot = prefix(F.col("_key"), bits).alias("slot")
    slots = stored(directory(keys.groupBy(slot).agg(F.count(F.lit(1)).alias("n")), bits, capacity), f"{base}/directory")

    shared = prefiltered(rows, "_key", keys.where("_n > 1").select("_key"))
    folded = shared.groupBy("_key", "_text", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")).agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    alone = keys.where("_n = 1").select("_key", F.lit(None).cast("string").alias("_text"), "_top", "_n", F.lit(True).alias("_alone"))
    arriving = folded.select("_key", "_text", "_top", "_n", F.lit(False).alias("_alone")).union(alone).withColumn("slot", slot)
    owned = arriving.join(slots, "slot").select("bucket", "_key", "_text", "_top", "_n", "_alone").repartition("bucket")
    same_key = Window.partitionBy("bucket", "_key", "_alone")
    chained = owned.withColumn("chain", F.dense_rank().over(same_key.orderBy("_text")).cast("long"))
    links = chained.groupBy("bucket", "_key", "_alone", "chain").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"), F.first("_text").alias("_text"))
    links = links.withColumn("_rows", F.sum("group_size").over(same_key)).withColumn("_links", F.max("chain").over(same_key))
    # The filter before may let a text through whose key occurs once; that key is here already.
    links = links.where("_alone or _rows > 1").withColumn("_text", F.when(F.col("_links") > 1, F.col("_text")))
    index = links.select("bucket", "_key", "chain", "keep_id", "group_size", "_text").sortWithinPartitions("bucket", "_key", "chain")
    index = stored(index, f"{base}/index")
    remove(spark, f"{base}/keys")

    by_key = index.where("_text is null").drop("_text")
    found = even_lookup(light, by_key, ["_key"], "group_size", n_rows)
    by_bytes = index.where("_text is not null")
    clash = prefiltered(rows, "_key", by_bytes.select("_key").distinct()).join(by_bytes, ["_key", "_text"])
    clash = clash.select("_id", "_key", F.sha2("_text", 256).alias("text_sha256"), "bucket", "chain", "keep_id", "group_size")
    out = found.where("group_size is not null").unionByName(clash)
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")

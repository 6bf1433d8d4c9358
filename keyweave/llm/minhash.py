"""Near-duplicate detection by HyperMinHash: compressed registers, banding, corrected estimate, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from keyweave.llm.common import even_lookup, prefiltered, remove, shared_dir, stored

#: One hash per shingle: BUCKET_BITS choose one of K registers, the rest is the value whose minimum it keeps,
#: stored as leading zeros (6 bits) and the MANTISSA bits behind the leading one.
BUCKET_BITS, MANTISSA = 8, 10
K = 1 << BUCKET_BITS
#: BANDS bands of ROWS registers. Independent bands would miss a pair at a similarity of 0.8 with a chance of
#: (1 - 0.8**8)**88 = 1e-7. These all pick from the same K registers, which may agree less than the sets do: simulated
#: (4,000 pairs a size), the chance is 3e-5 to 4e-5 for unions of 5 to 150 shingles and about 1e-5 for 300 to 2,000.
BANDS, ROWS = 88, 8
#: A pair goes to the exact check unless its estimate lies so many standard errors below the threshold.
SIGMAS = 5.5
#: A bucket's pairs of unconnected documents are compared as they are if there are so many for each of its documents at
#: most; else its documents are dealt by the prefixes of their sets. There, LEADERS documents of a bucket with more pairs
#: are compared with all of it in a round, eight times as many in the next.
SPARSE, LEADERS = 8, 64
#: Rows of one key that a task pairs at most with a bucket's lesser components, and counters of the shingle sketch.
SPLIT, COUNTERS = 4096, 1 << 18
#: Rows sketched together; buckets are folded inside such a batch.
BATCH = 4096


def _tables():
    rng = np.random.default_rng(20240521)
    picks = np.stack([rng.permutation(K)[:ROWS] for _ in range(BANDS)])
    odd = rng.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = np.stack([rng.permutation(K - 1).astype(np.uint8) + np.uint8(1) for _ in range(K)])
    near = np.zeros((K, K), np.uint8)  # near[j]: a random order of the registers, j itself first
    for j in range(K):
        near[j, np.arange(K) != j] = order[j]
    return picks, odd, near


PICKS, ODD, NEAR = _tables()
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and nothing else changed."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole sequence as one if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = _mix(acc * _STEP + h[i : len(h) - width + 1 + i])
    return np.unique(acc)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The K registers (uint16, 0: empty): leading zeros and mantissa are a float's exponent and fraction."""
    regs = np.zeros(K, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its minimum
        value = (shingles[first] << np.uint64(BUCKET_BITS)) | np.uint64(1)
        bits = value.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
        regs[bucket[first]] = np.clip(bits.astype(np.int64) - (1023 << MANTISSA), 1, 65535)
    return regs


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers borrow from the first occupied one in their own random order, so small sets band like large ones."""
    held = np.flatnonzero(regs)
    return regs if len(held) in (0, K) else regs[held[NEAR[:, held].argmin(1)]]


def band_keys(dense: np.ndarray) -> np.ndarray:
    """(documents, BANDS) int64 keys of densified register rows."""
    out = np.empty((len(dense), BANDS), np.int64)
    for i in range(0, len(dense), 512):
        part = dense[i : i + 512].astype(np.uint64)[:, PICKS] + np.uint64(1)
        key = _mix((part * ODD).sum(2, dtype=np.uint64) ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP))
        out[i : i + 512] = key.view(np.int64)
    return out


@lru_cache(4096)
def _accidental(n_bin: int, m_bin: int) -> float:
    n, m = 2 ** (n_bin / 8), 2 ** (m_bin / 8)
    level = np.arange(1, 65, dtype=np.float64)[:, None]
    j = np.arange(1 << MANTISSA, dtype=np.float64)[None, :]
    low, high = ((1 << MANTISSA) + j + d for d in (0, 1))
    scale = 2.0 ** -(MANTISSA + level) / K
    inside = lambda size: np.exp(size * np.log1p(-low * scale)) - np.exp(size * np.log1p(-high * scale))
    return float((inside(n) * inside(m)).sum() * K)


def expected_collisions(n: int, m: int) -> float:
    """Registers in which two disjoint sets of n and m shingles agree by accident (sizes in eighths of an octave)."""
    return _accidental(round(8 * np.log2(max(n, 1))), round(8 * np.log2(max(m, 1))))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Collision-corrected Jaccard estimate and the number of registers that either set occupies."""
    used = int(((a != 0) | (b != 0)).sum())
    same = int(((a == b) & (a != 0)).sum())
    return (max(0.0, same - expected_collisions(n, m)) / used if used else 0.0), used


def promising(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with these registers may reach the threshold."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    est, used = estimate(a, b, n, m)
    p = percent / 100
    return est >= p - SIGMAS * (p * (1 - p) / max(used, 1)) ** 0.5


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, and how many of them are the first prefix.

    In an order that is the same for all sets, the first shingle that two sets share is followed by all others that they
    share. Similar sets share percent / 100 of the larger one's shingles at least, and 2 * percent / (100 + percent) of
    the smaller one's; so that shingle is in the prefix of the larger set and in the shorter, first one of the smaller.
    """
    n = len(shingles)
    rarest = np.lexsort((shingles, counts[(shingles >> np.uint64(20)).astype(np.int64) & (len(counts) - 1)]))
    return shingles[rarest[: n - -(-percent * n // 100) + 1]], n - -(-2 * percent * n // (100 + percent)) + 1


_FEATURES = "doc_id long, n_shingles long, fp binary, sketch binary, lead array<long>, lead_n array<int>, member array<long>, links array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary()), ("lead", pa.list_(pa.int64())),
                    ("lead_n", pa.list_(pa.int32())), ("member", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


def _sketch(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, BATCH) for whole in batches for i in range(0, whole.num_rows, BATCH)):
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            sets = [shingle_set(words_of(t.as_py()), n) for t in texts]
            rows = [[i, len(s), None, None, [], [], [], []] for i, s in zip(ids, sets, strict=True)]
            seen: dict[bytes, int] = {}
            kept = []
            for at, s in enumerate(sets):
                if not len(s) or ids[at] is None:
                    continue
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows[at][2] = fp
                if (lead := seen.setdefault(fp, at)) != at:
                    rows[at][7].append(ids[lead])  # an equal set in this batch: linked, and banded once
                else:
                    kept.append(at)
            if kept:
                regs = np.stack([registers(sets[at]) for at in kept])
                keys = band_keys(np.stack([densified(r) for r in regs]))
                for at, r in zip(kept, regs, strict=True):
                    rows[at][3] = r.tobytes()
                # Inside the batch each bucket is folded to its first document, so a hot bucket leaves a task as one row a batch.
                flat = keys.ravel()
                order = np.argsort(flat, kind="stable")
                run_at = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
                count = np.diff(np.r_[run_at, len(flat)])
                leads = np.repeat(order[run_at], count)
                is_lead = np.zeros(len(flat), bool)
                is_lead[order[run_at]] = True
                size = np.zeros(len(flat), np.int32)
                size[order[run_at]] = count
                pairs = {(int(a), int(b)) for a, b in zip(leads[leads != order] // BANDS, order[leads != order] // BANDS, strict=True)}
                for a, b in sorted(pairs):
                    if promising(regs[a], regs[b], len(sets[kept[a]]), len(sets[kept[b]]), percent) and similar(sets[kept[a]], sets[kept[b]], percent):
                        rows[kept[b]][7].append(ids[kept[a]])
                is_lead, size = is_lead.reshape(keys.shape), size.reshape(keys.shape)
                for at, key, lead, k in zip(kept, keys, is_lead, size, strict=True):
                    rows[at][4:7] = key[lead].tolist(), k[lead].tolist(), key[~lead].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_ARROW)], schema=_ARROW)

    return run


def _promising(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            go = []
            for n, m, x, y, same in zip(cols["na"], cols["nb"], cols["sa"], cols["sb"], cols["same"], strict=True):
                # Of sets that are equal one in a batch has no sketch; its pairs with others come from the one that has.
                go.append(bool(same) or x is not None and y is not None and promising(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m, percent))
            yield pa.RecordBatch.from_pydict({k: cols[k] for k in ("a", "b", "same")}, schema=_PAIR).filter(pa.array(go, pa.bool_()))

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.bool_())])


def _confirmed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            go = []
            for i in range(batch.num_rows):
                a, ta, tb = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if last[0] != (a, ta):
                    last = ((a, ta), shingle_set(words_of(ta), n))
                go.append(similar(last[1], shingle_set(words_of(tb), n), percent))
            yield batch.select([0, 1]).filter(pa.array(go, pa.bool_()))

    return run


def _links(pairs: DataFrame, feats: DataFrame, docs: DataFrame, n: int, percent: int, base: str) -> DataFrame:
    """Of candidate pairs (a < b) those whose sets are similar: size and estimate first, then the full sets."""
    feats = feats.where(F.col("fp").isNotNull())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    narrow = prefiltered(feats, "doc_id", ids)
    side = lambda c: narrow.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("fp").alias(f"f{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb", (F.col("fa") == F.col("fb")).alias("same"))
    likely = stored(both.mapInArrow(_promising(percent), "a long, b long, same boolean").distinct(), f"{base}/likely")
    check = likely.where(~F.col("same")).select("a", "b")
    texts = prefiltered(docs, "doc_id", check.select(F.explode(F.array("a", "b")).alias("id")))
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    full = check.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb").sortWithinPartitions("a")
    sure = full.mapInArrow(_confirmed(n, percent), "a long, b long")
    return stored(likely.where("same").select("a", "b").union(sure).distinct(), f"{base}/links")


def components(links: DataFrame, base: str) -> DataFrame:
    """(doc_id, root): the smallest id that links reach, for ids that have links.

    Alternates large-star and small-star steps until nothing moves; every round is a written table. A hub's
    neighbours are folded by map-side minimum, and its own rows find that minimum by broadcast (even_lookup).
    """
    spark = links.sparkSession
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{base}/round0")
    state, k = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        if state == tuple(now) or not now[0]:
            return edges.select(F.col("v").alias("doc_id"), F.col("u").alias("root"))
        state, k = tuple(now), k + 1
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count(F.lit(1)).alias("w"))
        large = even_lookup(both, low, ["x"], "w", 2 * now[0]).where("y > x and y <> m").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = stored(large.distinct(), f"{base}/large{k}")
        down = large.toDF("x", "y")
        low = down.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("w"))
        met = even_lookup(down, low, ["x"], "w", now[0])
        small = met.select(F.col("x").alias("v"), F.col("m").alias("u")).union(met.where("y <> m").select("y", "m"))
        edges = stored(small.distinct(), f"{base}/round{k}")
        for old in [f"round{k - 1}", f"large{k}"]:
            remove(spark, f"{base}/{old}")


def _sums(members: DataFrame) -> DataFrame:
    """Of each key with pairs of documents of different components, one of them first: (key, rows, big, crowded), big being
    its largest component, crowded whether there are more than SPARSE such pairs for each row. Folded on the map side."""
    per = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if("first").alias("f"))
    sums = per.groupBy("key").agg(F.sum("k").alias("rows"), F.sum("f").alias("firsts"), F.sum(F.col("k") * F.col("f")).alias("same"), F.max_by("c", F.struct("k", "c")).alias("big"))
    pairs = F.col("rows") * F.col("firsts") - F.col("same")
    return sums.where(pairs > 0).select("key", "rows", "big", (pairs > 2 * SPARSE * F.col("rows")).alias("crowded"))


def _met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of documents of two components that share a key and may be similar by what is known of their places.

    A key's right rows are split into parts of about SPLIT; left rows, which are few, are repeated for each part. Where
    keys are shingles, the smaller set must have its in the shorter prefix (`first`), and what follows in both sets must
    suffice for the threshold; for the first shingle that similar sets share, both hold. Bands have no places (n = 0).
    """
    parts = F.ceil(F.col("rows") / SPLIT).cast("int")
    columns = ["id", "c", "place", "n", "first"]
    one = left.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.struct(*columns).alias("x"))
    other = right.select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.struct(*columns).alias("y"))
    both = one.join(other, ["key", "part"]).where("x.c <> y.c").select(F.expr("IF(x.n < y.n OR x.n = y.n AND x.id < y.id, x, y)").alias("s"), F.expr("IF(x.n < y.n OR x.n = y.n AND x.id < y.id, y, x)").alias("l"))
    enough = f"100 * s.n >= {percent} * l.n AND least(s.n - s.place, l.n - l.place) * {100 + percent} >= {percent} * (s.n + l.n)"
    fits = both.where(f"l.n = 0 OR s.first AND {enough}")
    return fits.select(F.least("s.id", "l.id").alias("a"), F.greatest("s.id", "l.id").alias("b")).where("a < b").distinct()


def _rarest(docs: DataFrame, crowd: DataFrame, n: int, percent: int, base: str) -> DataFrame:
    """(id, key, place, n, first) of the documents in crowd (id): a key for each shingle of the prefix of a document's set,
    its place there, the size of the set, and whether it is in the first prefix.

    The order of shingles is that of their counts over the crowd, as a sketch of COUNTERS counters knows them; the
    sketch is all that the driver sees, and its mistakes only make prefixes less rare.
    """
    spark = docs.sparkSession
    texts = stored(prefiltered(docs, "doc_id", crowd.select("id")).join(crowd, F.col("doc_id") == F.col("id")).select("id", "text"), f"{base}/crowd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                slots = (shingle_set(words_of(t.as_py()), n) >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)
                np.add.at(total, slots, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    sketch = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    found = sketch.toArrow()  # Arrow, as a Python row for each counter would fill the driver
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words_of(t.as_py()), n) for t in batch.column(1)]
            keys = [prefix(s, shared.value, percent) for s in sets]
            size = [len(k) for k, _ in keys]
            at = np.repeat(np.arange(len(keys)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            flat = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in keys]]).view(np.int64)
            whole, first = (np.array(x, np.int64)[at] for x in ([len(s) for s in sets], [f for _, f in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, (flat, place, whole, place < first))], names=["id", "key", "place", "n", "first"])

    return stored(texts.mapInArrow(deal, "id long, key long, place long, n long, first boolean"), f"{base}/rarest")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id that links reach), kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| of their distinct n-word shingles (whole
    sequence if shorter; none without words). Candidates: documents that share a band of compressed registers.
    1. Sketch, band, and fold buckets inside each Arrow batch, where links to a bucket's first document are
       checked at once; the band index goes to the shared folder.
    2. Across batches each document is checked against the bucket leader (smallest member) that it shares most
       buckets with. Links give components.
    3. Every remaining pair of one bucket that lies in two components is a candidate too; pairs already connected need
       no check. Where a bucket has more than SPARSE such pairs a document, as many texts with one common passage have,
       its documents are dealt anew, by the rarest shingles of their sets (an exact way: similar sets share one, early
       in both), and step 3 is done there. Buckets that still have more pairs go in rounds: leaders are compared with the
       whole bucket and lead no more, and what they link lies in one component in the next.
    Each candidate passes the estimate and then the check on full sets, wherever it comes from.
    Null or blank texts and null ids are linked with nothing; a null id has a null component_id and stays. Rows
    that repeat an id share a component, whatever their texts. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    feats = stored(docs.mapInArrow(_sketch(n, percent), _FEATURES), f"{base}/sketches")
    leads = feats.select(F.col("doc_id").alias("id"), F.inline(F.arrays_zip(F.col("lead").alias("key"), F.col("lead_n").alias("n"))))
    w = Window.partitionBy("key")
    met = leads.select("id", "key", F.min("id").over(w).alias("first"), F.sum("n").over(w).alias("size")).where("size > 1")
    member = feats.select(F.col("doc_id").alias("id"), F.explode("member").alias("key"), F.lit(None).cast("long").alias("first"))
    live = stored(met.select("id", "key", "first").union(member), f"{base}/buckets")
    # One pair a document at first: with the bucket leader that it shares most buckets with.
    star = live.where("first < id").groupBy("id", "first").agg(F.count(F.lit(1)).alias("k"))
    star = star.groupBy("id").agg(F.max_by("first", F.struct("k", -F.col("first"))).alias("a")).select("a", F.col("id").alias("b"))
    star = stored(star, f"{base}/star")
    links = _links(star, feats, docs, n, percent, f"{base}/one")
    near = feats.select(F.col("doc_id").alias("b"), F.explode("links").alias("a")).select("a", "b")
    links = near.union(links)
    root = components(links, f"{base}/comp1")

    members = live.select("id", "key", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    step, leaders, columns = 0, 0, members.columns
    while True:
        step += 1
        at = f"{base}/step{step}"
        members = members.join(root.withColumnRenamed("doc_id", "id"), "id", "left").select(*columns, F.coalesce("root", "id").alias("c"))
        members = stored(members, f"{at}/members")
        sums = stored(_sums(members), f"{at}/sums")
        crowds, weight = sums.agg(F.count_if("crowded"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if not weight:
            break
        mixed = stored(even_lookup(members, sums, ["key"], "rows", weight).where("rows is not null"), f"{at}/mixed")
        few, crowded = mixed.where("not crowded"), mixed.where("crowded")
        # Of each pair one is first. Either that one lies outside the key's largest component, or the other one does.
        pairs = _met(few.where("first and c <> big"), few, percent).union(_met(few.where("not first and c <> big"), few.where("first and c = big"), percent))
        if leaders and crowds:
            near = Window.partitionBy("key", "salt").orderBy("rank", "id")
            whole = Window.partitionBy("key").orderBy("rank", "id")
            lead = crowded.where("first").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.xxhash64("id", "key"))
            lead = lead.withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= leaders)
            lead = lead.withColumn("_at", F.row_number().over(whole)).where(F.col("_at") <= leaders)
            lead = stored(lead.select(*mixed.columns), f"{at}/leaders")
            pairs = pairs.union(_met(lead, crowded, percent))
        found = _links(stored(pairs.distinct(), f"{at}/pairs"), feats, docs, n, percent, at)
        if not found.isEmpty():
            root = components(root.select(F.col("root").alias("a"), F.col("doc_id").alias("b")).union(found), f"{at}/comp")
        if not crowds:
            break
        if not leaders:
            members, leaders = _rarest(docs, crowded.select("id").distinct(), n, percent, at), LEADERS
        else:
            led = lead.select("id", "key", "place", F.lit(True).alias("_led")).distinct()
            left = crowded.join(led, ["id", "key", "place"], "left").withColumn("first", F.col("first") & F.col("_led").isNull())
            members, leaders = left.select(*columns), 8 * leaders
    out = feats.select("doc_id", "n_shingles").join(root, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), (F.col("root").isNull() | (F.col("root") == F.col("doc_id"))).alias("kept"))

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyweave.llm import exact_dedup as ed, minhash as mh
from keyweave.llm.common import HEAVY, even_lookup, prefiltered

DDL = "doc_id long, text string, kept string, bucket int, _key int, text_sha256 int, n_shingles int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], DDL)


def brute_components(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(r.randint(8, 90))] for _ in range(12)]
    rows = [(-1, None), (0, ""), (1, " \t\n"), (2, "one two"), (3, "ONE two"), (4, "one"), (5, "É two"), (6, "é two"), (7, "a b c d"), (8, "A b\tc d")]
    for i in range(10, n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = w[: len(w) // 2] + passage
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    for n, seed in ((4, 1), (5, 2)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in mh.near_duplicates(docs(spark, rows).repartition(7), n).collect()}
        assert got == brute_components(rows, n)


def test_chains_equal_brute_force(spark):
    """Neighbours of a chain are similar, its ends are not: most links join documents with other leaders."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(6):
        w = [word() for _ in range(70)]
        for _ in range(30):
            at = r.randrange(66)
            w[at : at + 3] = [word() for _ in range(3)]
            rows.append(" ".join(w))
    ids = r.sample(range(1000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    got = {x.doc_id: x.component_id for x in mh.near_duplicates(docs(spark, rows).repartition(9), 4).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(rows, 4).items()}


@pytest.mark.parametrize("sparse", [0, 1])
def test_crowds_equal_brute_force(spark, monkeypatch, sparse):
    """All mixed buckets, or those with a few pairs, go through prefixes and then through rounds of single leaders."""
    monkeypatch.setattr(mh, "SPARSE", sparse)
    monkeypatch.setattr(mh, "LEADERS", 1)
    monkeypatch.setattr(mh, "SPLIT", 3)
    monkeypatch.setattr(mh, "BATCH", 5)
    rows = corpus(3, 120)
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs(spark, rows).repartition(11), 4).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(rows, 4).items()}


def test_recall_of_bands_and_estimate():
    """Pairs at the threshold: each shares a band, and none is lost by the estimate."""
    r = np.random.default_rng(3)
    found = total = 0
    for union in (5, 10, 40, 150, 600):
        for _ in range(300):
            both, own = r.integers(0, 2**63, union * 4 // 5, dtype=np.uint64), r.integers(0, 2**63, union - union * 4 // 5, dtype=np.uint64)
            cut = r.integers(0, len(own) + 1)
            a, b = np.unique(mh._mix(np.r_[both, own[:cut]])), np.unique(mh._mix(np.r_[both, own[cut:]]))
            assert mh.similar(a, b, 80)
            ra, rb = mh.registers(a), mh.registers(b)
            ka, kb = mh.band_keys(np.stack([mh.densified(ra), mh.densified(rb)]))
            found += bool((ka == kb).any()) and mh.promising(ra, rb, len(a), len(b), 80)
            total += 1
    assert found >= total - 1


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(4)
    counts = r.integers(0, 4, 1 << 10)
    for _ in range(500):
        n = int(r.integers(1, 40))
        base = r.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = (np.unique(r.choice(base, n, replace=False)) for _ in range(2))
        if r.random() < 0.7:
            b = np.unique(np.r_[a[r.random(len(a)) < 0.93], b[: len(b) // 10], a[:1]])
        if mh.similar(a, b, 80):
            (s, short), (l, _) = (mh.prefix(x, counts, 80) for x in sorted((a, b), key=len))
            both = np.intersect1d(s[:short], l)
            i, j = min((s.tolist().index(x), l.tolist().index(x)) for x in both)
            assert 180 * min(min(len(a), len(b)) - i, max(len(a), len(b)) - j) >= 80 * (len(a) + len(b))


def test_one_id_with_several_texts_links_all_of_them(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, two), (1, one + " c"), (9, two + " c"), (7, "z " * 9)]
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs(spark, rows).repartition(5), 4).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 7: 7}


def test_near_duplicates_edge_rows(spark):
    same = [(None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (3, "a b c d e"), (4, None), (5, "x " * 30000)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in mh.near_duplicates(docs(spark, same), 4).collect())
    assert got == [(-1, -1, True), (3, 3, True), (4, 4, True), (5, 5, True), (9, 3, False), (9, 3, False)]
    assert mh.near_duplicates(docs(spark, []), 4).collect() == []


def test_estimate_is_close():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, own = r.integers(0, 2**63, 800, dtype=np.uint64), r.integers(0, 2**63, (2, 100), dtype=np.uint64)
        a, b = (np.unique(mh._mix(np.r_[common, x])) for x in own)
        est, used = mh.estimate(mh.registers(a), mh.registers(b), len(a), len(b))
        errors.append(est - 0.8)
    assert used > 240 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert 0 < mh.expected_collisions(1000, 1000) < 1


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 800)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    from keyweave.llm.common import shared_dir

    got = {x.doc_id: x.root for x in mh.components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert all(got.get(x, x) == m for x, m in root.items())


def brute_copies(rows):
    best, size = {}, {}
    for i, t in rows:
        best[t or ""], size[t or ""] = max(i, best.get(t or "", -1)), size.get(t or "", 0) + 1
    return {i: (best[t or ""], size[t or ""], best[t or ""] == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


COPY_ROWS = [(i, random.Random(i).choice([None, "", "a", "A", "a ", "b" * 50_000, "é", "é", "\x00", f"only {i}"])) for i in range(300)]


@pytest.mark.parametrize("key", [F.xxhash64, F.length, lambda t: F.lit(5)])
def test_exact_dedup_equals_brute_force(spark, key):
    """With a key that many texts share, too: links of one key are told apart by their bytes."""
    got = ed.exact_dedup(docs(spark, COPY_ROWS).repartition(5), capacity=2, key=key).collect()
    assert {x.doc_id: tuple(x)[1:5] for x in got} == brute_copies(COPY_ROWS)
    chains = {}
    for x in got:
        chains.setdefault(x.text_sha256, set()).add((x.bucket, x.chain))
    assert all(len(c) == 1 for c in chains.values())
    if key is not F.xxhash64:
        texts = {t or "" for _, t in COPY_ROWS}
        same = max(sum(len(t) == n for t in texts) for n in map(len, texts)) if key is F.length else len(texts)
        assert max(x.chain for x in got) == same


def test_exact_dedup_needs_its_index(spark, monkeypatch):
    """Groups are larger than any row that reaches their owner, and nothing is found without the directory."""
    rows = [(i, "one text") for i in range(400)]
    assert {x.group_size for x in ed.exact_dedup(docs(spark, rows)).collect()} == {400}
    monkeypatch.setattr(ed, "directory", lambda slots, bits, capacity: slots.selectExpr("slot", "slot AS bucket", "0 AS depth").limit(0))
    assert ed.exact_dedup(docs(spark, rows)).count() == 0


def test_exact_dedup_edge_rows(spark):
    found = ed.exact_dedup(docs(spark, [(None, "q"), (2, "z"), (2, "z"), (None, "z")])).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(None, None, 1, True), (None, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]))
    assert ed.exact_dedup(docs(spark, [])).collect() == []


def plain_directory(slots, bits, capacity):
    """Insert keys one by one; an overfull bucket splits by its next bit and doubles the directory where it must."""
    depth, table = 0, [{"depth": 0, "keys": []}]
    for slot in (s for s, n in slots.items() for _ in range(n)):
        while True:
            bucket = table[slot >> (bits - depth)]
            if len(bucket["keys"]) < capacity or bucket["depth"] == bits:
                bucket["keys"].append(slot)
                break
            if bucket["depth"] == depth:
                depth, table = depth + 1, [b for b in table for _ in (0, 1)]
            halves = [{"depth": bucket["depth"] + 1, "keys": []} for _ in (0, 1)]
            for k in bucket["keys"]:
                halves[k >> (bits - bucket["depth"] - 1) & 1]["keys"].append(k)
            at = [i for i, b in enumerate(table) if b is bucket]
            for n, i in enumerate(at):
                table[i] = halves[n * 2 // len(at)]
    first = {}
    for i, b in enumerate(table):
        first.setdefault(id(b), i << (bits - depth))
    return {s: (first[id(table[s >> (bits - depth)])], table[s >> (bits - depth)]["depth"]) for s in slots}


def test_directory_equals_insertion(spark):
    r = random.Random(5)
    for slots, bits, capacity in [({0: 3, 1: 3, 4: 1, 7: 1}, 3, 4), ({5: 100}, 3, 4), ({0: 2}, 0, 4), ({r.randrange(256): r.randrange(1, 9) for _ in range(90)}, 8, 12)]:
        got = ed.directory(spark.createDataFrame(list(slots.items()), "slot long, n long"), bits, capacity).collect()
        assert {x.slot: (x.bucket, x.depth) for x in got} == plain_directory(slots, bits, capacity)


def test_even_lookup_and_bitmap(spark):
    left = spark.range(5000).select((F.col("id") % 4).alias("k"), "id").union(spark.range(3000).select(F.lit(77).cast("long"), "id"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 2")
    got = even_lookup(left, right, ["k"], "n", 8000)
    want = left.join(right, "k", "left").select("k", "id", "n", "top")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert right.where(F.col("n") > 8000 // HEAVY).count() == 4
    ids = spark.createDataFrame([(3,), (-5,), (2**40,)], "x long")
    kept = {r.id for r in prefiltered(spark.createDataFrame([(i,) for i in [*range(1000), -5, 2**40]], "id long"), "id", ids).collect()}
    assert {3, -5, 2**40} <= kept and len(kept) < 20


def test_shingle_sketch_stays_small_on_the_driver(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(str(r.random()) for _ in range(500))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) AS text")
    tracemalloc.start()
    got = mh._rarest(df, df.selectExpr("doc_id AS id"), 4, 80, f"file://{tmp_path}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and got.count() == sum(len(mh.prefix(mh.shingle_set(t.encode().split(), 4), np.zeros(mh.COUNTERS, np.int64), 80)[0]) for _, t in rows)

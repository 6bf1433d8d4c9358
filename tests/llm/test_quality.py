import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyweave.llm import quality_rules as qr, rule_ensemble as re_, training


def corpus(n=400):
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(60, 200))]
        kind = i % 5
        if kind == 0:
            w = [x + r.choice(["###", "$$$", "***"]) for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind > 1), 0))
    return rows, labels


DOC, LAB = "doc_id long, text string, kept string, SCORE int, _text int, _s_upper int, n_words int", "doc_id long, quality int, toxic int"


def frames(spark, rows, labels):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4) for i, t in rows], DOC), spark.createDataFrame(labels, LAB)


def test_held_out_and_sample(spark):
    import zlib

    rows, labels = corpus(200)
    docs, lab = frames(spark, rows, [*labels, (None, 1, 0), (3, None, 0)])
    ids = [r.doc_id for r in training.labelled(docs, lab, 10_000).collect()]
    assert sorted(ids) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(training.labelled(docs, lab, 20).collect()) == 20
    # rows that repeat an id, and labels that repeat, don't lift the bound
    again = docs.where("doc_id = 0").withColumn("text", F.lit("a"))
    many = training.labelled(docs.unionByName(again).unionByName(docs), lab.unionByName(lab), 10_000).collect()
    assert sorted(r.doc_id for r in many) == sorted(ids) and {r.text for r in many if r.doc_id == 0} == {"a"}


def test_profiles_are_bounded_and_tell_characters_apart():
    at, share, _ = qr.profile(" ".join(chr(0x4E00 + i % 20_000) + str(i) for i in range(300_000)))
    assert len(at) <= (1 << qr.WORD_BITS) + (1 << qr.CHAR_BITS) and share.sum() == pytest.approx(2, rel=1e-3)
    one, two = (set(qr.profile(t)[0].tolist()) for t in ("漢字漢", "字漢字"))
    assert one != two and len(qr.profile("")[0]) == 0


def test_fit_holds_little_beside_its_rows():
    """The driver holds what it learns from once, and a part of it while it learns."""
    r = np.random.default_rng(3)
    each, n = 10_000, 200
    rows = [(i % 2, (np.sort(r.choice(1 << 17, each, replace=False)).astype(np.int32), np.full(each, 1 / each, np.float32), i % 5 == 0)) for i in range(n)]
    tracemalloc.start()
    qr.fit(rows, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * each * n and not rows


def test_fit_takes_rows_without_grams():
    empty = qr.profile("")
    some = qr.profile("a few words of some text")
    assert qr.fit([(i % 2, empty) for i in range(9)]).probability(0.0) == pytest.approx(0.5, abs=0.1)
    mixed = qr.fit([(0, empty), (0, empty), (1, some), (1, some), (0, empty)])
    assert mixed.score("a few words of some text", qr.word_hashes(b"a few words of some text".split())) > mixed.score("", np.empty(0, np.uint64))


def brute_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if __import__("re").search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


EDGES = [None, "", " \n\n ", "a", "a a a a", "a b c a b c", "é x\nq\nq\r\nq", "x\n\nx\n \nx", "|#* <>", "w " * 49, "b " * 60, "long" * 30_000]


def test_counts_equal_brute_force(spark):
    rows, labels = corpus(60)
    rows += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "n"), (5, "again")]
    docs, lab = frames(spark, rows, labels)
    got = qr.judged(docs, qr.train(docs, lab)).collect()
    assert len(got) == len(rows) and {"SCORE", "_text"} <= set(got[0].asDict())
    texts = {i: t or "" for i, t in rows[:-1]}
    for r in got:
        if r.doc_id != 5:
            c = brute_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
            assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and (not r.base_failed or not r.kept)


@pytest.mark.parametrize("which", ["grams", "rules"])
def test_held_out_accuracy(spark, which):
    rows, labels = corpus()
    docs, lab = frames(spark, rows, labels)
    if which == "grams":
        got = {r.doc_id: int(r.kept) for r in qr.judged(docs, qr.train(docs, lab)).collect()}
    else:
        got = {r.doc_id: r.predicted for r in re_.scored(docs, re_.train(docs, lab)).collect()}
    held = {r.doc_id for r in docs.where(training.held_out(docs.doc_id)).collect()}
    right = [got[i] == q for i, q, _ in labels if i in held]
    assert len(right) > 80 and np.mean(right) > 0.97


def test_compiled_rules_equal_the_model(spark):
    rows, labels = corpus(200)
    docs, lab = frames(spark, rows + [(900 + i, t) for i, t in enumerate(EDGES)], labels)
    model = re_.train(docs, lab)
    assert 0 < len(model.rules) < 80 and all(len(r) <= re_.DEPTH for r, _ in model.rules)
    got = re_.scored(docs, model).select("doc_id", "score", "_s_upper")
    stats = docs.select("doc_id", *[c.alias(k) for k, c in re_.statistics(docs.text).items()]).collect()
    want = dict(zip([r[0] for r in stats], model.score(np.array([list(map(float, r[1:])) for r in stats])), strict=True))
    assert all(abs(want[r.doc_id] - r.score) < 1e-9 and 0 <= r.score <= 1 and r["_s_upper"] == 3 for r in got.collect())


def test_hundreds_of_rules_are_one_shallow_expression(spark):
    """As many rules as the trees can have: a sum nested in sums overflowed the planner's stack."""
    rng = np.random.default_rng(3)
    most = re_.TREES * (2 ** (re_.DEPTH + 1) - 2)
    rules = [(tuple((int(rng.integers(len(re_.NAMES))), bool(rng.integers(2)), float(rng.random() * 4)) for _ in range(re_.DEPTH)), float(rng.normal() / 9)) for _ in range(most)]
    model = re_.Ensemble(0.1, rules)
    docs = spark.createDataFrame(corpus(40)[0], "doc_id long, text string")
    x = {r[0]: np.array([r[1:]], float) for r in docs.select("doc_id", *[c.alias(k) for k, c in re_.statistics(F.col("text")).items()]).collect()}
    got = {r.doc_id: r.score for r in re_.scored(docs, model).collect()}
    assert got.keys() == x.keys() and all(abs(got[i] - model.score(v)[0]) < 1e-9 for i, v in x.items())


def test_without_labels_and_rows(spark):
    rows, labels = corpus(20)
    docs, lab = frames(spark, rows, [(i, 1, 0) for i, _ in rows])
    for none in (lab.limit(0), lab):
        assert all(0 <= r.score <= 1 for r in re_.scored(docs, re_.train(docs, none)).collect())
        assert len({r.probability for r in qr.judged(docs, qr.train(docs, none)).collect()}) == 1
    assert re_.scored(docs.limit(0), re_.train(docs, lab)).count() == qr.judged(docs.limit(0), qr.train(docs, lab)).count() == 0


def test_statistics_by_parts_are_those_of_whole_texts(spark, monkeypatch):
    r = random.Random(4)
    texts = ["", " ", "\n\n", " a  A a\n\na ", "x \n", "漢 漢 😀\n😀", None] + ["".join(r.choice("aAb \n\t|!.1漢😀") for _ in range(r.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    cols = lambda: [c.alias(k) for k, c in re_.statistics(F.col("text")).items()]
    whole = {x.id: x for x in rows.select("id", *cols()).collect()}
    monkeypatch.setattr(re_, "PART", 3)
    assert {x.id: x for x in rows.select("id", *cols()).collect()} == whole
    import re

    for i, t in enumerate(t or "" for t in texts):
        words, lines = re.findall(r"[^ \t-\r]+", t), t.split("\n")
        tokens = re.split(r"[ \t-\r]+", t.lower())
        n = max(len(words), 1)
        got = whole[i]
        assert got.word_length == max(len(t), 1) / n and got.upper == t.count("A") / max(len(t), 1) and got.pipe == t.count("|") / n
        assert got.same_word == sum(a == b for a, b in zip(words, words[1:])) / n
        assert got.distinct == len(set(tokens)) / len(tokens) and got.distinct_lines == len(set(lines)) / len(lines)


def test_a_long_text_fits_a_small_heap():
    """30 million characters in 900 MB, where an object for each capital does not fit."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession, functions as F
from keyweave.llm import rule_ensemble
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(1).select(F.concat(F.repeat(F.lit("ABCDEFG H\\n"), 3_000_000), F.col("id").cast("string")).alias("text"))
r = rows.select(*[c.alias(k) for k, c in rule_ensemble.statistics(F.col("text")).items()]).first()
assert abs(r.upper - 0.8) < 1e-6 and r.distinct == 3 / 6_000_001 and r.distinct_lines == 2 / 3_000_001, r
print("done")
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 900m pyspark-shell", "SPARK_LOCAL_IP": "127.0.0.1"}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "done" in got.stdout, got.stderr[-2000:]


@pytest.mark.parametrize("n, x", [(10, np.arange(120.0).reshape(10, 12)), (100, np.ones((100, 12)))])
def test_rows_without_a_rule_give_their_rate(n, x):
    model = re_.fit(x, np.array([0.0, 1.0, 1.0, 1.0, 1.0] * (n // 5)))
    assert model.rules == [] and model.score(x) == pytest.approx([(0.8 * n + 1) / (n + 2)] * n)

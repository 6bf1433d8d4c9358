import os

import pytest

import corpus_pipeline as cp
from keyweave.llm import queries
from tests.llm.test_dedup import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EDGE = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "", "en", "s", 0), (-4, "one two", None, "s", 7), (None, "no id here", None, None, None), (-5, "w " * 40_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output over the documents with edge rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(EDGE, docs.schema)).cache()
    out = {}
    for name, stage in cp.STAGES[2:-1]:
        out[name] = (docs.collect(), stage(spark, docs, SF).collect())
    return docs.collect(), out


def test_names_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [cp.keep_by_rules, cp.keep_by_classifier])
def test_rules_and_classifier_keep_clean_and_drop_junk(spark, stage):
    sf = SF.replace("0.001", "0.01")  # the smallest tables have too few bad examples to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in stage(spark, docs, sf).collect()}
    long = [r for r in docs.collect() if r.doc_id in quality and len(r.text.split()) >= 50]
    assert sum((r.doc_id in ids) == bool(quality[r.doc_id]) for r in long) >= 0.98 * len(long)


def test_stages_take_missing_and_further_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "x", 5), (2, None, "y", 6), (2, "one two three", "z", 7)], "doc_id long, text string, kept string, N_CHARS long")
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == list(cp.COLUMNS) and {r.lang for r in got.collect()} <= {None}


def test_packing_stage_takes_edge_rows(spark):
    docs = spark.createDataFrame([*EDGE, EDGE[0]], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = cp.pack(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in got if r.start == 0), key=str) == sorted((e[0] for e in [*EDGE, EDGE[0]]), key=str)
    assert [r.doc_tokens for r in got if r.doc_id == -1] == [1, 1] and cp.pack(spark, docs.limit(0), SF).count() == 0


def test_first_stages_take_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for stage in (cp.keep_by_rules, cp.keep_by_classifier):
        assert {r.doc_id for r in stage(spark, docs, SF).collect()} <= {e[0] for e in EDGE}


def test_exact_stage(stages):
    before, after = stages[1]["exact_dedup"]
    best = {}
    for r in before:
        if r.doc_id is not None:
            best[r.text or ""] = max(r.doc_id, best.get(r.text or "", r.doc_id))
    want = {r.doc_id for r in before if r.doc_id is None or best[r.text or ""] == r.doc_id}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_repeated_rows_stay_once(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(9, "a b c d e f", "en", "s", 1), (9, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "other words of seven here", "en", "s", 2), (5, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = cp.drop_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(5, ""), (7, "other words of seven here"), (9, "a b c d e f")]
    got = cp.drop_near_copies(spark, docs.where("doc_id = 9"), SF).collect()
    assert [(r.doc_id, r.text) for r in got] == [(9, "a b c d e f")]


def test_near_stage(stages):
    before, after = stages[1]["near_dedup"]
    kept = {i for i, (_, _, k) in brute_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5).items() if k}
    assert {r.doc_id for r in after} == kept | {None}


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    got = cp.run(spark, SF)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall(), key=str)

"""The corpus pipeline: documents in, packed training sequences out, one training-data operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyweave.llm import quality_rules, rule_ensemble
from keyweave.llm.common import shared_dir, stored
from keyweave.llm.exact_dedup import exact_dedup
from keyweave.llm.minhash import near_duplicates
from keyweave.llm.packing import packed
from keyweave.llm.queries import TOKENIZER

#: The columns of documents. A stage returns these; one that its input lacks is null, further ones are left behind.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    return docs.select(*[docs[c] if c in have else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labelled corpus that models learn from: the original one, as a filtered stage has lost its bad examples."""
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))


def _only(docs: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """Rows of docs whose `on` (id, or id and text digest) is kept, one of those with the same id and text.

    Rows without an id are never in a group and stay.
    """
    docs = _documents(docs)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    some = docs.where("doc_id is not null").withColumn("text_sha256", digest).join(kept.where("kept").select(*on), on, "left_semi")
    same = Window.partitionBy("doc_id", "text_sha256").orderBy("lang", "source", "n_chars", "text")
    some = some.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return some.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (9): documents that they reject go. Empty tables, nulls and ties: as quality_rules.judged says."""
    model = quality_rules.train(*_tables(spark, sf_dir))
    return quality_rules.judged(_documents(docs), model).where("kept").select(*COLUMNS)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (4): documents that it rejects go. Null and empty texts are scored like any other.

    A score of exactly one half keeps; rows that repeat have one score and all stay; an empty table gives none.
    """
    model = rule_ensemble.train(*_tables(spark, sf_dir))
    return rule_ensemble.scored(_documents(docs), model).where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (3): of equal texts one row with the largest id stays, whatever other texts share the ids of the rest."""
    return _only(docs, exact_dedup(docs), ["doc_id", "text_sha256"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (1) on five-word shingles at 0.8: one document of each component stays, that of its smallest id.

    Repeated rows of that id stay once; rows of that id with unlike texts count as one document and stay.
    """
    return _only(docs, near_duplicates(docs, n=5, percent=80), ["doc_id"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (7): every kept document in sequences of 2048 tokens; one row per piece.

    Null and empty texts are one token, rows that repeat are documents of their own, null ids stay, an empty table gives
    none; pieces of one length go in the order of their ids.
    """
    return packed(docs, TOKENIZER)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Models, near duplicates and tokens are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

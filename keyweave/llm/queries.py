"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyweave.llm import quality_rules, rule_ensemble
from keyweave.llm.bpe import with_ids, with_text
from keyweave.llm.chat import formatted, loss_texts, parsed
from keyweave.llm.common import shared_dir
from keyweave.llm.exact_dedup import exact_dedup
from keyweave.llm.html_text import extracted
from keyweave.llm.minhash import near_duplicates
from keyweave.llm.packing import packed
from keyweave.llm.simple8b import read_digests, write_tokens
from keyweave.llm.training import held_out
from keyweave.llm.urls import judged, train as train_urls

#: The tokenizer file of the contracts; the operators take any byte-level one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), n=4, percent=80)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, _read(spark, sf_dir, "labels"))
    return rule_ensemble.scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The conversation that the contract adds: texts that look like another template's control strings.
EXTRA_TURNS = "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA_TURNS))
    got = formatted(turns).withColumn("_turns", parsed("formatted")).withColumn("_loss", F.concat_ws("", loss_texts()))
    digest = F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return got.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS opens,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS m
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN opens THEN m + 23 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

#: (verdict, host, path) of the contract.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    model = train_urls(pages, _read(spark, sf_dir, "documents").select("text"))
    return judged(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_read(spark, sf_dir, "documents"), TOKENIZER)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_tokens(_read(spark, sf_dir, "documents"), path, TOKENIZER)
    return read_digests(spark, path)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, model).drop("text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = with_ids(_read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).select("doc_id", "ids")
    return with_text(ids, TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_html_text": op2_html_text,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
}
SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL}

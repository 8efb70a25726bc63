"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm.chat import digests, formatted
from tallyline.llm.common import written
from tallyline.llm.conversation_repair import repairs
from tallyline.llm.decontamination import contaminated
from tallyline.llm.exact_dedup import exact_groups
from tallyline.llm.oracles import LLM_ORACLES
from tallyline.llm.language_id import identified
from tallyline.llm.packing import pack
from tallyline.llm.secrets import secrets_found
from tallyline.llm.simhash import simhash_groups
from tallyline.llm.token_files import token_index, write_token_files
from tallyline.llm.surrogates import replaced
from tallyline.llm.vector_codes import vector_codes
from tallyline.llm.vector_dedup import near_vectors
from tallyline.llm.warc import derivatives, responses
from tallyline.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
# A job over real data passes a secret of its own.
SURROGATE_KEY = "tallyline-demo-key"
# The pages have no capture time.
WARC_DATE = "2024-01-01T00:00:00Z"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, with the item and the alignment."""
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, rendered, written and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table.unionByName(odd)
    return digests(written(formatted(rows), "chats"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets_found(_documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, and how many mentions were."""
    found = replaced(_documents(spark, sf_dir), SURROGATE_KEY)
    return found.select("doc_id", "text", F.size("surrogate_kinds").cast("long").alias("n_replaced"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    path = scratch_path(spark, "token-files")
    write_token_files(_documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return token_index(spark, path)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens."""
    return pack(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identified(_documents(spark, sf_dir))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of every page."""
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), WARC_DATE))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(_documents(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_groups(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    return repairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_token_files": op6_token_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}
__all__ = ["LLM_ORACLES", "LLM_QUERIES"]

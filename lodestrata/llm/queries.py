"""The registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm import minhash, quality, topk
from lodestrata.llm.common import shared_dir, table

MULTI = "byte_bpe_multi_50k.tiktoken"
ENGLISH = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKENIZERS = {"byte_bpe_50k": (public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN), "byte_bpe_multi_50k": (public_tokenizers.path(MULTI), public_tokenizers.PATTERN)}
#: A deployment passes a key of its own.
PII_KEY = "key of the registered queries"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.suffixes import digest

    return digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN, added=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.langid import learn_and_predict

    return learn_and_predict(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality import digest

    return digest(table(spark, sf_dir, "documents"))


def op7_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def rollup_batches(docs: DataFrame) -> list[tuple[str, DataFrame, list[str] | None]]:
    """Name, changes and tokenizer versions of op8's batches: all documents under
    one version, under the other, and the first again; then a seventh of them is
    deleted and another revised, and at last both are as they were."""
    docs = docs.select("doc_id", "source", "lang", "text")
    seventh = F.pmod(F.col("doc_id").cast("long"), F.lit(7))

    def change(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("change"), *docs.columns)

    inserts, gone, other = change("insert", docs), docs.where(seventh == 0), docs.where(seventh == 1)
    revised = other.withColumns({"source": F.col("lang"), "text": F.expr("substr(text, 1, length(text) div 2)")})
    without_text = lambda rows: change("delete", rows.withColumns({c: F.lit(None).cast("string") for c in ("source", "lang", "text")}))
    return [
        ("0001", inserts, ["byte_bpe_50k"]),
        ("0002", inserts, ["byte_bpe_multi_50k"]),
        ("0001", inserts, ["byte_bpe_50k"]),
        ("0003", without_text(gone).unionByName(change("revise", revised)), None),
        ("0004", without_text(other).unionByName(change("insert", docs.where(seventh < 2))), None),
    ]


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizer versions after rollup_batches()."""
    from lodestrata.llm.rollup import TokenRollup

    rollup = TokenRollup(spark, f"{shared_dir(spark)}/lodestrata/rollup-{uuid.uuid4().hex}", TOKENIZERS)
    for name, changes, versions in rollup_batches(table(spark, sf_dir, "documents")):
        rollup.commit(name, changes, versions)
    return rollup.totals()


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_quality_ledger": op6_quality_ledger,
    "op7_hash_ring": op7_hash_ring,
    "op8_token_rollup": op8_token_rollup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_cover_tree_top_k": op10_cover_tree_top_k,
}

ORACLE_SQL: dict[str, str] = {"op4_minhash_near_dedup": minhash.SQL, "op6_quality_ledger": quality.SQL, "op10_cover_tree_top_k": topk.SQL}

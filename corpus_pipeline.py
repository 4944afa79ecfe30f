"""A training corpus from raw documents: five stages, each written as Parquet and
read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestrata.llm.common import discard, materialize, table
from lodestrata.llm.minhash import representatives
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.pii import pseudonymise
from lodestrata.llm.quality import ledger, passes
from lodestrata.llm.suffixes import with_text, without_repeats

#: The policy that stage one applies.
POLICY = 4
#: Where the session has the pseudonyms' key (Spark crosses out such settings where it
#: prints them), and the public key that takes its place in tests and examples.
KEY_SETTING, KEY = "spark.lodestrata.pii.secret", "key of the registered queries"


def _rows(docs: DataFrame, *columns: Column) -> DataFrame:
    """`columns`, and each whole row in the column `row`: so stages don't depend on
    what other columns the documents have, or on their names."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _as_before(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The rows in the documents' columns; with a new text, and its length, if given."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy stay as they are, with all their columns. A null
    or empty text fails; repeated rows and null ids are judged each for itself; texts
    of any length are measured whole. No documents, no rows."""
    return _as_before(ledger(_rows(docs, F.col("text"))).where(passes(POLICY)), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles one row stays:
    the least by doc_id (null: last), and of those by its text's MD5; of rows that
    repeat doc_id and text, any one. Rows without words are in no group, but repeated
    ones count once too. Texts of any length are compared whole; other columns stay as
    they are. No documents, no rows."""
    stay = representatives(docs, size=5, percent=80)
    rows = _rows(docs, F.col("doc_id").cast("long").alias("doc_id"), _text_key())
    same = rows["doc_id"].eqNullSafe(stay["doc_id"]) & rows["text_key"].eqNullSafe(stay["text_key"])
    return _as_before(rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text_key"]), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand at two places go from all of them; characters
    that are cut into go too. A null text stays null, texts under 200 bytes stay, equal
    texts of 200 bytes or more all become empty. No row goes, whatever its id; other
    columns but n_chars stay as they are. No documents, no rows."""
    rows = with_text(_rows(docs, _text_key()), without_repeats(docs).select("text_key", "kept_text"))
    return _as_before(rows, docs, F.col("kept_text"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms of the same format under the session's
    key (KEY_SETTING). A null or empty text stays; rows don't depend on each other, and
    equal ones stay equal; texts may be of any length. No row goes; other columns but
    n_chars stay as they are. No documents, no rows."""
    key = spark.conf.get(KEY_SETTING, KEY)
    return _as_before(pseudonymise(_rows(docs, F.col("text")), key), docs, F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids, and their places in sequences of 1024
    tokens. A null or empty text is the end id alone; of repeated rows and null ids
    each is packed for itself; a text of any length is cut into whole pieces. Only
    doc_id and text are read. No documents, no rows."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs

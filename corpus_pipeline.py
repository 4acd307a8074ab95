"""The corpus pipeline: five operators in a row, from documents to token ids.

Every stage takes a table with doc_id, text and source, and further columns of any
names, which all stages but the last hand on. Defined results, stage by stage: a
null or empty text fails the quality rules, is one text to the near-duplicate
stage, has no personal data, contributes nothing to the mix, and gives no ids; a
very long text is read whole by every stage; repeated rows are judged, redacted
and encoded each, become one row in the near-duplicate stage, and are taken singly
by the mix; of ties in it the least doc_id stays, a null doc_id last; an empty table
stays empty. A stage's docstring says what it decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import bpe, mixing, pii, quality_rules, simhash
from plinth.llm.common import documents, new_folder

#: SQL can't express byte-pair merges, so the whole has no counterpart; tests compare it with a brute-force version.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base limits whose posterior probability of being good is one half or more; all columns stay."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; all columns stay.

    Texts link by op8's contract: fingerprints of three-word shingles that differ in at most three of 64 bits.
    """
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text, other columns stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so none to twice; all columns stay."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("quality rules", filter_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs

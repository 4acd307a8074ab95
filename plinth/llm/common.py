"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.batches import slices  # noqa: F401  (for the operators)
from plinth.functions.text import let  # noqa: F401  (for the operators)
from plinth.sources.shared import new_folder, stored  # noqa: F401  (for the operators)

#: White space of the row contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r" \t-\r"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs with all columns in one struct ``row``, beside copies of its own ones named; so no name of an operator can clash with theirs."""
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row")).select("row", *(F.col(f"row.{c}").alias(c) for c in own))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

"""Tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source_path, and text with line feeds as its only line ends."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return docs.select(F.col("doc_id").alias("document_id"), path.alias("source_path"), text.alias("text"), "lang", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, and the embedding in double precision."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))

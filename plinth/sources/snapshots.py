"""Immutable generations of chunks and vectors under a folder, with a pointer to the active one.

A generation is written as Parquet in a folder of its own, counted, and only then
named by a pointer, a one-row table of its own whose name is its sequence. A name
that is taken is refused, so of two commits at once one fails. Readers follow the
last pointer, so a failed write leaves the previous generation active. A manifest
beside the vectors tells how they were made, and is checked when they are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA_VERSION = 2
_POINTER = "sequence long, snapshot_id string, parent_snapshot_id string, n_chunks long, n_vectors long"


def _pointers(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).option("recursiveFileLookup", "true").json(f"{folder}/pointers")
    except AnalysisException:
        return None


def active(spark: SparkSession, folder: str):
    """The row of the active generation, or None."""
    rows = _pointers(spark, folder)
    return rows.orderBy(F.desc("sequence"), "snapshot_id").first() if rows is not None else None


def status(spark: SparkSession, folder: str) -> str:
    """not_initialized, incomplete (no chunks) or ready."""
    row = active(spark, folder)
    return "not_initialized" if row is None else "ready" if row["n_chunks"] else "incomplete"


def commit(folder: str, chunks: DataFrame, vectors: DataFrame | None = None, parent: str | None = None, manifest: dict[str, str] | None = None) -> str:
    """Writes chunks (chunk_id, ...) and vectors (chunk_id, embedding, ...) as a new generation and makes it the active one.

    A chunk id that occurs twice, a vector without a chunk, vectors of different lengths or representations (a column, where there is
    one), and another commit that was faster are errors; the generation is then not named. ``manifest`` is kept with the vectors.
    """
    spark = chunks.sparkSession
    before = active(spark, folder)
    name = uuid.uuid4().hex
    base = f"{folder}/generations/{name}"
    chunks.withColumns({"snapshot_id": F.lit(name), "schema_version": F.lit(SCHEMA_VERSION)}).write.parquet(f"{base}/chunks")
    written = spark.read.parquet(f"{base}/chunks")
    if not written.groupBy("chunk_id").count().where("count > 1").isEmpty():
        raise ValueError("a chunk id occurs twice")
    n_vectors = 0
    if vectors is not None:
        vectors.withColumn("snapshot_id", F.lit(name)).write.parquet(f"{base}/vectors")
        index = spark.read.parquet(f"{base}/vectors")
        if not index.join(written, "chunk_id", "left_anti").isEmpty():
            raise ValueError("a vector has no chunk")
        kinds = [F.count_distinct(c) for c in ("representation",) if c in index.columns]
        n_vectors, widths, *others = index.agg(F.count("*"), F.count_distinct(F.size("embedding")), *kinds).first()
        if widths > 1 or any(n > 1 for n in others):
            raise ValueError("vectors differ in length or representation")
        width = index.select(F.size("embedding")).first()[0] if n_vectors else 0
        facts = {**(manifest or {}), "snapshot_id": name, "n_vectors": str(n_vectors), "dimensions": str(width)}
        spark.createDataFrame([(facts,)], "manifest map<string,string>").coalesce(1).write.json(f"{base}/manifest")
    sequence = 0 if before is None else before["sequence"] + 1
    row = (sequence, name, parent, written.count(), n_vectors)
    try:
        spark.createDataFrame([row], _POINTER).coalesce(1).write.mode("errorifexists").json(f"{folder}/pointers/{sequence:012d}")
    except AnalysisException as taken:
        raise ValueError("another commit was faster") from taken
    named = _pointers(spark, folder).where(F.col("sequence") == sequence).orderBy("snapshot_id").first()
    if named["snapshot_id"] != name:  # both wrote before either was there
        raise ValueError("another commit was faster")
    return name


def manifest_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """What is known of the active generation's vectors; a manifest of another generation, or another number of vectors, is an error."""
    row = active(spark, folder)
    if row is None or not row["n_vectors"]:
        raise ValueError("the folder has no vectors")
    facts = spark.read.schema("manifest map<string,string>").json(f"{folder}/generations/{row['snapshot_id']}/manifest").first()["manifest"]
    if facts["snapshot_id"] != row["snapshot_id"] or int(facts["n_vectors"]) != row["n_vectors"]:
        raise ValueError("the manifest doesn't fit the vectors")
    return facts


def read(spark: SparkSession, folder: str, what: str = "chunks") -> DataFrame:
    """Chunks or vectors of the active generation; rows of any other, and vectors that their manifest doesn't fit, are an error."""
    row = active(spark, folder)
    if row is None:
        raise ValueError("the folder has no generation")
    if what == "vectors":
        manifest_of(spark, folder)
    rows = spark.read.parquet(f"{folder}/generations/{row['snapshot_id']}/{what}")
    own = F.when(F.col("snapshot_id") == row["snapshot_id"], F.col("snapshot_id")).otherwise(F.raise_error(F.lit("rows of another snapshot")).cast("string"))
    return rows.withColumn("snapshot_id", own)


def child(spark: SparkSession, folder: str, vectors: DataFrame) -> str:
    """A generation with the active one's chunks and new vectors."""
    row = active(spark, folder)
    return commit(folder, read(spark, folder).drop("snapshot_id", "schema_version"), vectors, row["snapshot_id"])


def migrate(folder: str, legacy: DataFrame, dry_run: bool = False) -> dict:
    """Brings chunks of an older layout (schema_version 0 to 2, or none) into a first generation; dry_run only counts."""
    version = F.coalesce(F.col("schema_version"), F.lit(0)) if "schema_version" in legacy.columns else F.lit(0)
    found = {r["v"]: r["count"] for r in legacy.groupBy(version.alias("v")).count().collect()}
    if bad := sorted(v for v in found if not 0 <= v <= SCHEMA_VERSION):
        raise ValueError(f"unknown schema versions {bad}")
    name = None if dry_run else commit(folder, legacy.drop("schema_version", "snapshot_id"))
    return {"snapshot_id": name, "versions": found}

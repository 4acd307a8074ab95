"""Embeddings that outlive a run: a provider is asked once for each text and configuration.

The cache is a folder for each configuration, named by its digest, that holds
generations of rows (text_hash, embedding) and increments beside them. A run looks
its texts' hashes up, asks the provider for those that are missing, each distinct
text once, and writes what it got as an increment before anything is handed on; the
next run finds it there. ``compact`` makes one generation of all: sorted by hash, so
that a scan for few hashes reads few parts of it, without the repeats that two runs
at once may leave. Readers see increments by the generation that they belong to,
so a compaction takes nothing away from a run that has begun.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plinth.sources import generations
from plinth.sources.providers import Provider, embed

ROW = "text_hash string, embedding array<double>"


@dataclass
class EmbeddingCache:
    """The cache of one configuration (provider, model, representation, ...) under a folder. ``asked`` counts the texts of the last run
    that the provider was asked for, ``found`` those that were there."""

    spark: SparkSession
    folder: str
    configuration: dict[str, str]
    asked: int = 0
    found: int = 0
    _base: str = field(init=False)

    def __post_init__(self) -> None:
        named = json.dumps(self.configuration, sort_keys=True)
        self._base = f"{self.folder.rstrip('/')}/{hashlib.sha256(named.encode()).hexdigest()[:32]}"

    def _increments(self) -> str:
        """Where the increments since the current generation are."""
        now = generations.current(self._base)
        return f"{self._base}/since-{now['generation'] if now else 'the-beginning'}"

    def known(self) -> DataFrame:
        """(text_hash, embedding), a text's hash once; of repeats any."""
        parts = []
        now = generations.current(self._base)
        if now and now["files"]:
            parts.append(generations.read(self.spark, self._base))
        try:
            parts.append(self.spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(self._increments()))
        except AnalysisException:
            pass
        if not parts:
            return self.spark.createDataFrame([], ROW)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy("text_hash").agg(F.any_value("embedding").alias("embedding"))

    def embed(self, rows: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
        """Rows (chunk_id, text) as (chunk_id, text_hash, embedding); null text is empty text. Vectors of another length than those
        that are known are an error, and nothing of them is kept."""
        hashed = rows.select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
        known = self.known()
        texts = hashed.groupBy("text_hash").agg(F.any_value("text").alias("text"))
        new = texts.join(known.select("text_hash"), "text_hash", "left_anti")
        before = known.select(F.size("embedding").alias("n")).first()
        path = f"{self._increments()}/{uuid.uuid4().hex}"
        made = embed(new.select(F.col("text_hash").alias("chunk_id"), "text"), provider, batch).select("text_hash", "embedding")
        wanted = F.lit(before["n"] if before else None).cast("int")
        fits = F.when(wanted.isNull() | (F.size("embedding") == wanted), F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in length from those that are known")).cast("array<double>"))
        made.select("text_hash", fits.alias("embedding")).write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(ROW).parquet(path)
        self.asked = written.count()
        self.found = texts.count() - self.asked
        return hashed.select("chunk_id", "text_hash").join(known.unionByName(written), "text_hash").select("chunk_id", "text_hash", "embedding")

    def compact(self) -> dict:
        """Makes one generation of all that is known and returns its manifest; later increments belong to it."""
        return generations.write(self.known(), self._base, "text_hash")

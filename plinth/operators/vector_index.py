"""A stored vector index with exact results: groups around pivots, ruled out by the triangle inequality.

Vectors are scaled to length one, so that cosine is 1 - d^2 / 2 of their distance d.
Pivots are PIVOTS vectors at most, about the square root of all, drawn by a hash of
their ids; each vector belongs to its nearest. Groups of more than BLOCK vectors are
dealt into parts, so none is larger, whatever share of the vectors is alike. Of each
part the greatest distance from its pivot, the radius, is kept. No vector of a part
can be nearer to a query than the pivot's distance less the radius.

A search scores each query against the parts of the FIRST best bounds, which gives
a threshold, the cosine of the last result so far, and then against those whose
bound reaches it, and no others. Queries come in blocks by a hash of their id, so a
task holds one part and one block. Results are those of comparing all with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.retrieval import best_of, check_limit, top
from plinth.sources.shared import new_folder, sent, stored

#: Pivots at most, vectors of a part and queries of a block, about, and parts that are scored before there is a threshold.
PIVOTS, BLOCK, FIRST = 1024, 1 << 13, 2
#: What rounding may add to a distance.
SLACK = 1e-7


def _units(vectors: pa.ListArray) -> np.ndarray:
    """Rows scaled to length one; zero vectors stay. Rows of different lengths are an error."""
    widths = set(vectors.value_lengths().to_pylist())
    if len(widths) > 1 or None in widths:
        raise ValueError("vectors differ in length")
    rows = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), widths.pop() if widths else 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def write(index: DataFrame, folder: str | None = None) -> str:
    """Writes an index of vectors (chunk_id, embedding) of one length and returns its folder, a new one under the shared folder if none is named."""
    spark = index.sparkSession
    folder = folder or new_folder(spark, "vectors")
    rows = index.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(PIVOTS, int(n**0.5) + 1)).toArrow()  # PIVOTS at most
    pivots = _units(_column(drawn, "embedding")) if drawn.num_rows else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column("embedding"))
            if units.shape[1] != shared.value.shape[1]:
                raise ValueError("vectors differ in length")
            d = _distances(units, shared.value)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], ["chunk_id", "embedding", "pivot", "distance"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    near = stored(rows.mapInArrow(assign, f"chunk_id {kind}, embedding array<double>, pivot int, distance double"), "near")
    parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))  # a row a pivot
    dealt = near.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
    dealt.repartitionByRange("pivot", "part").sortWithinPartitions("pivot", "part").write.option("compression", "zstd").parquet(f"{folder}/vectors")
    found = spark.read.schema(f"chunk_id {kind}, embedding array<double>, pivot int, distance double, part int").parquet(f"{folder}/vectors")
    centres = spark.createDataFrame(pa.table({"pivot": pa.array(np.arange(len(pivots)), pa.int32()), "centre": pa.array(list(pivots), pa.list_(pa.float64()))}))
    groups = found.groupBy("pivot", "part").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(F.broadcast(centres), "pivot")
    groups.coalesce(1).write.parquet(f"{folder}/groups")
    return folder


@dataclass
class VectorIndex:
    """An index that ``write`` has written. ``report`` says of the last search how many (query, part) pairs there were and were scored."""

    spark: SparkSession
    folder: str
    report: dict[str, int] = field(default_factory=dict)

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """As retrieval.semantic_search of the queries (query_id, embedding) over the vectors of the index."""
        check_limit(limit)
        groups = self.spark.read.parquet(f"{self.folder}/groups").orderBy("pivot", "part").toArrow()  # a row for BLOCK vectors, or for a pivot
        if not groups.num_rows or not limit:
            kind = self.spark.read.parquet(f"{self.folder}/vectors").schema["chunk_id"].dataType.simpleString()
            return queries.where("false").select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("chunk_id"), F.lit(0.0).alias("score"))
        shared = self.spark.sparkContext.broadcast((np.stack(_column(groups, "centre").to_numpy(zero_copy_only=False)), *(groups.column(c).to_numpy() for c in ("radius", "pivot", "part"))))
        asked = stored(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "asked")
        n = asked.count()
        blocks = max(1, -(-n // BLOCK))
        kind = asked.schema["query_id"].dataType.simpleString()

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The parts that a query still needs: the first ones where it has no threshold yet, then those that reach it."""
            centres, radius, pivot, part = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    units = _units(some.column("embedding"))
                    if units.shape[1] != centres.shape[1]:
                        raise ValueError("vectors differ in length")
                    least = np.maximum(_distances(units, centres) - radius[None] - SLACK, 0)
                    # a zero vector has the cosine 0 with all, others less than a zero query's bound allows
                    most = np.where((units * units).sum(1)[:, None] > 0, 1 - least * least / 2, 0.0)
                    zero = (centres * centres).sum(1)[None] + radius[None] < 1 - 1e-9
                    most = np.where(zero | (least == 0), np.maximum(most, 0.0), most)
                    order = np.argsort(-most, axis=1, kind="stable")
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
                    first = place < FIRST
                    threshold = some.column("threshold").to_numpy(zero_copy_only=False).astype(np.float64) if "threshold" in some.schema.names else None
                    need = first if threshold is None else ~first & (np.isnan(threshold)[:, None] | (most >= threshold[:, None] - SLACK))
                    q, g = np.nonzero(need)
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), some.column("embedding").take(pa.array(q)), pa.array(pivot[g]), pa.array(part[g])], ["query_id", "embedding", "pivot", "part"])

        def score(chunks: pa.Table, queries: pa.Table) -> pa.Table:
            if chunks.num_rows and queries.num_rows:
                chunks = chunks.sort_by("chunk_id").combine_chunks()
                a, b = _units(_column(queries, "embedding")), _units(_column(chunks, "embedding")).T
                found = []
                step = max(1, (1 << 21) // b.shape[1])
                for at in range(0, len(a), step):
                    scores = a[at : at + step] @ b
                    q, c = best_of(scores, min(limit, b.shape[1]))
                    found.append((q + at, c, scores[q, c]))
                q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
            else:
                q, c, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "chunk_id": chunks.column("chunk_id").take(pa.array(c)), "score": pa.array(s)})

        def scored(rows: DataFrame) -> tuple[DataFrame, int]:
            pairs = rows.mapInArrow(bounded, f"query_id {kind}, embedding array<double>, pivot int, part int")
            pairs = stored(pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "pairs")
            key = ["pivot", "part", "block"]
            wanted = stored(pairs.select(*key).distinct(), "wanted")
            chunks = vectors.select("chunk_id", "embedding", "pivot", "part").join(sent(wanted), ["pivot", "part"])
            own = vectors.schema["chunk_id"].dataType.simpleString()
            found = chunks.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInArrow(score, f"query_id {kind}, chunk_id {own}, score double")
            return top(found, limit), pairs.count()

        vectors = self.spark.read.parquet(f"{self.folder}/vectors")
        early, n_first = scored(asked)
        early = stored(early, "early")
        reached = early.where(F.col("rank") == limit).select("query_id", F.col("score").alias("threshold"))
        late, n_rest = scored(asked.join(sent(reached), "query_id", "left"))
        self.report = {"pairs": n * groups.num_rows, "scored": n_first + n_rest}
        return top(early.unionByName(late).select("query_id", "chunk_id", "score"), limit)

"""Ranking chunks for many queries at once.

Chunks are (chunk_id, text), queries (query_id, query). Results are (query_id,
rank, chunk_id, score): the best ``limit`` of each query by score, ties by id.

Up to SENT_TOKENS different (query, token) pairs, counted before, the queries are
sent to all tasks, and no token is shuffled: one narrow pass tokenises the chunks
in the JVM and keeps, inside each chunk's row, which tokens of the queries it has
and how often; the rows are written once, document frequencies are one small
aggregation over them, and a second narrow pass scores a batch of rows at a time
and hands on each query's best alone. Beyond, query tokens join the postings on the
token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import tokens
from plinth.sources.shared import stored

K1, B = 1.5, 0.75
RRF_K, WIDEN, LEAST = 60, 4, 20
#: Vectors of one block, about; a block of queries and one of the index meet in a group, so this bounds its memory.
VECTOR_BLOCK = 1 << 13
#: Blocks of the index at least, once it has enough vectors, so that groups spread over the cluster.
SPREAD, SPREAD_FROM = 16, 1 << 9
#: Scores of one matrix product.
SCORES = 1 << 21
#: Different (query, token) pairs, and queries, up to which the queries are sent to all tasks; beyond, both sides are shuffled.
SENT_TOKENS, SENT_QUERIES = 1 << 20, 1 << 14


def check_limit(limit: int) -> None:
    if limit < 0:
        raise ValueError("limit must not be negative")


def top(scored: DataFrame, limit: int) -> DataFrame:
    """Adds rank by score, then chunk_id; keeps the best ``limit`` of each query."""
    check_limit(limit)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "chunk_id", "score")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token, and how often the query has it."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def best_of(scores: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``kept`` highest scores of each row; of ties, to nine digits, the first columns."""
    shown = np.round(scores, 9)
    edge = np.partition(shown, -kept, axis=1)[:, -kept, None]
    above, ties = shown > edge, shown == edge
    return np.nonzero(above | (ties & (np.cumsum(ties, axis=1) <= kept - above.sum(axis=1, keepdims=True))))


def _sent(rows: DataFrame, n: int):
    """rows for a join: marked for sending where their number n, counted before, allows it."""
    return F.broadcast(rows) if n <= SENT_TOKENS else rows


def postings(chunks: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """token, chunk_id, tf, and the chunk's length in tokens; only the tokens ``among`` others, where given."""
    rows = chunks.select("chunk_id", tokens(F.col("text")).alias("tokens"))
    rows = rows.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    rows = rows if among is None else rows.join(among, "token", "left_semi")
    return rows.groupBy("chunk_id", "length", "token").agg(F.count("*").alias("tf"))


#: Chunks whose tokens are counted at once.
COUNTED = 1024


def counted_tokens(chunks: DataFrame, wanted: list[str]) -> DataFrame:
    """chunk_id, length in tokens, and two arrays: which of the wanted tokens a chunk has, by their place in the list, and how often."""
    shared = chunks.sparkSession.sparkContext.broadcast(pa.array(wanted, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, COUNTED) for whole in batches for i in range(0, whole.num_rows, COUNTED)):
            lists = batch.column("tokens")
            at = pc.index_in(lists.flatten(), shared.value)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            known = np.asarray(pc.is_valid(at))
            pair = row[known] * len(wanted) + np.asarray(pc.drop_null(at), np.int64)
            pair, count = np.unique(pair, return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(lists) + 1) * len(wanted)), pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % max(1, len(wanted)), count)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pc.list_value_length(lists), *arrays], ["chunk_id", "length", "at", "tf"])

    rows = chunks.select("chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, length int, at array<int>, tf array<int>")


def _ranked_in_batches(counted: DataFrame, queries: pa.Array, pairs: tuple, limit: int, saturation: tuple[float, float, float] | None, kind: str) -> DataFrame:
    """The best ``limit`` chunks of each query: scores of a batch at a time, each query's best of it, then of all.

    pairs: query numbers, token numbers and weights, ordered by token. saturation: k1, b and the average length; none counts tokens.
    """
    query, token, weight = pairs
    shared = counted.sparkSession.sparkContext.broadcast((queries, query, np.searchsorted(token, np.arange(int(token.max(initial=-1)) + 2)), weight))
    step = max(1, SCORES // max(1, len(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, query, starts, weight = shared.value
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("chunk_id").combine_chunks()
            for part in (batch.slice(i, step).combine_chunks() for i in range(0, batch.num_rows, step)):
                at, tf = (part.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "tf"))
                length = part.column("length").to_numpy().astype(np.float64)
                row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part.column("at"))))
                part_score = tf.astype(np.float64)
                if saturation is not None:
                    k1, b, average = saturation
                    ratio = length[row] / average if average > 0 else 0.0
                    part_score = tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))
                n = starts[at + 1] - starts[at]
                scores = np.zeros(len(asked) * part.num_rows)
                ends = np.cumsum(n)
                for first in range(0, len(at), 1 << 14):  # postings at a time, so that few matches are spelled out at once
                    last = min(first + (1 << 14), len(at))
                    m = n[first:last]
                    pick = np.repeat(starts[at[first:last]] - (ends[first:last] - m), m) + np.arange(ends[first] - m[0], ends[last - 1])
                    scores += np.bincount(query[pick] * part.num_rows + np.repeat(row[first:last], m), weight[pick] * np.repeat(part_score[first:last], m), len(scores))
                scores = scores.reshape(len(asked), part.num_rows)
                q, c = best_of(scores, min(limit, part.num_rows)) if limit and scores.size else (np.empty(0, np.int64),) * 2
                some = scores[q, c] > 0
                q, c = q[some], c[some]
                columns = [asked.take(pa.array(q)), part.column("chunk_id").take(pa.array(c)).combine_chunks(), pa.array(scores[q, c])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "score"])

    return top(counted.mapInArrow(run, f"query_id {kind}, chunk_id {counted.schema['chunk_id'].dataType.simpleString()}, score double"), limit)


@dataclass(frozen=True)
class Counted:
    """What the first narrow pass finds for some queries, for searches of either kind: the queries' tokens and the chunks' counts of them;
    none where the queries are too many to be sent."""

    wanted: pa.Table | None = None
    words: pa.Array | None = None
    chunks: DataFrame | None = None


def count_for(chunks: DataFrame, queries: DataFrame) -> Counted:
    """The first narrow pass; several searches of the same chunks for the same queries may share it."""
    wanted = stored(query_tokens(queries), "wanted")
    n, m = wanted.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n > SENT_TOKENS or m > SENT_QUERIES:
        return Counted()
    rows = wanted.select("query_id", "token", F.col("qtf").cast("double").alias("qtf")).toArrow().combine_chunks()
    words = pc.unique(rows.column("token"))
    return Counted(rows, words, stored(counted_tokens(chunks, words.to_pylist()), "counted"))


def _search(chunks: DataFrame, queries: DataFrame, limit: int, saturation: tuple[float, float] | None, found: Counted | None) -> DataFrame | None:
    """Results by the narrow passes; None where the queries are too many to be sent."""
    found = found or count_for(chunks, queries)
    rows, words, counted = found.wanted, found.words, found.chunks
    if counted is None:
        return None
    asked = pc.unique(rows.column("query_id"))
    query, token = (np.asarray(pc.index_in(rows.column(c), x), np.int64) for c, x in (("query_id", asked), ("token", words)))
    weight = rows.column("qtf").to_numpy()
    if saturation is not None:
        n_chunks, average = counted.agg(F.count("*"), F.avg("length")).first()
        df = counted.select(F.explode("at").alias("token")).groupBy("token").agg(F.count("*").alias("df")).toArrow()  # a row for each token of the queries at most
        seen = np.zeros(len(words))
        seen[df.column("token").to_numpy()] = df.column("df").to_numpy()
        weight = weight * np.log(1 + (n_chunks - seen + 0.5) / (seen + 0.5))[token]
        saturation = (*saturation, average or 0.0)
    else:
        weight = np.ones(len(token))
    order = np.argsort(token, kind="stable")
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
    return _ranked_in_batches(counted, asked, (query[order], token[order], weight[order]), limit, saturation, queries.schema["query_id"].dataType.simpleString())


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, average length in tokens (chunks without tokens count), distinct tokens, all tokens.

    One pass over the texts: a chunk's length goes with the first of its distinct tokens, and one aggregation takes all tokens.
    """
    words = chunks.select(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    rows = words.select(F.size("w").cast("long").alias("n"), F.posexplode_outer(F.array_distinct("w")).alias("place", "token"))
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    each = rows.groupBy("token").agg(F.count_if(first).alias("chunks"), F.sum(F.when(first, F.col("n"))).alias("n"))
    sums = each.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"), F.sum("n").alias("n"), F.count("token").alias("n_distinct"))
    return sums.select("n_chunks", F.try_divide(F.col("n").cast("double"), "n_chunks").alias("avg_length"), F.coalesce("n", F.lit(0)).alias("n_tokens"), "n_distinct")


def lexical_search(chunks: DataFrame, queries: DataFrame, limit: int = 10, counted: Counted | None = None) -> DataFrame:
    """Score: how many of a chunk's tokens are among the query's. ``counted`` may hand on ``count_for`` of the same chunks and queries."""
    check_limit(limit)
    found = _search(chunks, queries, limit, None, counted)
    return top(lexical_scores(chunks, queries), limit) if found is None else found


def lexical_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every pair that shares a token, by a join."""
    wanted = query_tokens(queries).select("query_id", "token")
    n = wanted.count()
    return postings(chunks, _sent(wanted.select("token").distinct(), n)).join(_sent(wanted, n), "token").groupBy("query_id", "chunk_id").agg(F.sum("tf").cast("double").alias("score"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of every pair with a score above 0, by a join; a token that a query repeats counts as often."""
    wanted = query_tokens(queries)
    n = wanted.count()
    size = chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avg_length"))
    hits = stored(postings(chunks, _sent(wanted.select("token").distinct(), n)), "postings")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weighed = df.join(_sent(wanted, n), "token").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("query_id", "token", (idf * F.col("qtf")).alias("weight"), "avg_length")
    ratio = F.when(F.col("avg_length") > 0, F.col("length") / F.col("avg_length")).otherwise(0.0)
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * ratio))
    return hits.join(_sent(weighed, n), "token").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")


def bm25_search(chunks: DataFrame, queries: DataFrame, limit: int = 10, k1: float = K1, b: float = B, counted: Counted | None = None) -> DataFrame:
    """As bm25_scores, the best ``limit`` of each query; ``counted`` as for lexical_search."""
    check_limit(limit)
    found = _search(chunks, queries, limit, (k1, b), counted)
    return top(bm25_scores(chunks, queries, k1, b), limit) if found is None else found


def cosine(left: str, right: str):
    """Cosine of two array columns; 0 where a norm is 0, an error where lengths differ."""
    a, b = F.col(left), F.col(right)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) for v in (a, b)]
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return same.otherwise(F.when((norms[0] == 0) | (norms[1] == 0), 0.0).otherwise(dot / (norms[0] * norms[1])))


def semantic_search(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Exact cosine of every vector (chunk_id, embedding) with every query vector (query_id, embedding); scores of any sign count.

    Up to VECTOR_BLOCK queries, counted before, are sent to all tasks, and the vectors, read once, stay where they are: a batch is
    multiplied with them and passes on each query's best ``limit`` only. Beyond, both sides are counted and dealt into blocks, and every
    pair of blocks is one group. A last ranking takes the best of all.
    """
    check_limit(limit)
    n = queries.count()
    if n <= VECTOR_BLOCK:
        return _semantic_in_batches(index, queries, limit)
    m = index.count()
    query_blocks = max(1, -(-n // VECTOR_BLOCK))
    index_blocks = max(1, -(-m // VECTOR_BLOCK), min(SPREAD, -(-m // SPREAD_FROM)))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": index.schema["chunk_id"].dataType.simpleString()}

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        """rows with the number of their own block, once for every block of the other side."""
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items() if name not in rows.columns]
        block = F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).alias(own)
        return rows.select("*", *empty, block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("chunk_id", "ascending")])
        return _nearest(table.filter(table["asks"]), table.filter(pc.invert(table["asks"])), limit)

    sides = dealt(queries.select("query_id", "embedding"), "query_block", query_blocks, "index_block", index_blocks).withColumn("asks", F.lit(True))
    sides = sides.unionByName(dealt(index.select("chunk_id", "embedding"), "index_block", index_blocks, "query_block", query_blocks).withColumn("asks", F.lit(False)))
    scored = sides.groupBy("query_block", "index_block").applyInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
    return top(scored, limit)


def _nearest(asked: pa.Table, chunks: pa.Table, limit: int) -> pa.Table:
    """The best chunks (chunk_id, embedding), in the order of their ids, of each query (query_id, embedding)."""

    def unit(vectors: pa.Array, width: int) -> np.ndarray:
        rows = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), width)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)

    kept = min(limit, len(chunks))
    found = []
    if kept and len(asked):
        a, b = (pa.concat_arrays(t["embedding"].chunks) for t in (asked, chunks))
        widths = {*pc.unique(a.value_lengths()).to_pylist(), *pc.unique(b.value_lengths()).to_pylist()}
        if len(widths) > 1 or None in widths:
            raise ValueError("vectors differ in length")
        (width,) = widths
        a, b = unit(a, width), unit(b, width).T
        step = max(1, SCORES // len(chunks))
        for at in range(0, len(a), step):
            scores = a[at : at + step] @ b
            q, c = best_of(scores, kept)
            found.append((q + at, c, scores[q, c]))
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "chunk_id": chunks["chunk_id"].take(pa.array(c)), "score": pa.array(score)})


def _semantic_in_batches(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries.select("query_id", "embedding").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _nearest(shared.value, pa.Table.from_batches([batch]).sort_by("chunk_id").combine_chunks(), limit)
            yield from found.combine_chunks().to_batches()

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (index, "chunk_id"))]
    return top(index.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), limit)


def known_vectors(chunks: DataFrame, index: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The vectors (chunk_id, embedding) of the chunks; those that ``index`` makes of the chunks themselves need no join."""
    return index(chunks) if callable(index) else index.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def fuse(sparse: DataFrame, dense: DataFrame, limit: int = 10, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked results; ties by the better rank, then id. ``origin`` is dense only where its rank is better."""
    check_limit(limit)
    a = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    b = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    parts = [F.coalesce(w / (k + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ("sparse_rank", "dense_rank"), strict=True)]
    both = both.withColumn("score", parts[0] + parts[1]).withColumn("best", F.least("sparse_rank", "dense_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best", "chunk_id")
    origin = F.when(F.col("sparse_rank").isNull() | (F.col("dense_rank") < F.col("sparse_rank")), "dense").otherwise("sparse")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "chunk_id", "score", "sparse_rank", "dense_rank", origin.alias("origin"))


def hybrid_search(chunks: DataFrame, index: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, query_vectors: DataFrame, limit: int = 10, counted: Counted | None = None) -> DataFrame:
    """BM25 and vectors, each widened to max(4 * limit, 20), fused. Vectors without a chunk are left out."""
    wide = max(WIDEN * limit, LEAST)
    return fuse(bm25_search(chunks, queries, wide, counted=counted), semantic_search(known_vectors(chunks, index), query_vectors, wide), limit)


def deduplicate(candidates: DataFrame) -> DataFrame:
    """The first of each chunk in a query's candidates (query_id, rank, chunk_id, ...), ranked anew."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    kept = candidates.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rehydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks' columns; a chunk that is gone, or ranks that aren't 1, 2, 3, ..., are an error."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranked.withColumn("place", place).join(chunks.withColumn("found", F.lit(True)), "chunk_id", "left")
    bad = F.when(F.col("found").isNull(), F.lit("a ranked chunk is missing")).when(F.col("place") != F.col("rank"), F.lit("ranks have gaps"))
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).otherwise(F.col("rank"))
    return rows.withColumn("rank", checked).drop("place", "found")


# Parts of the names of metadata that results don't show.
HIDDEN = ("api_key", "secret", "token", "authorization", "embedding", "vector", "text")


def redact_metadata(metadata):
    """A map without the keys that name secrets, vectors or text."""
    return F.map_filter(metadata, lambda k, _: ~k.rlike(f"(?i)({'|'.join(HIDDEN)})"))

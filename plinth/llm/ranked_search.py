"""Ranked lexical search: item weights times document impacts, as dense blocked matrix products.

Items are texts to search for. Their distinct terms are the vocabulary; one narrow
pass over the documents keeps, inside each document's row, its length and which
terms of the vocabulary it has how often. Document frequencies are sums of each
task's counts. A second narrow pass takes TILE rows at a time, spreads their
impacts over a dense matrix (terms of one vocabulary tile that these rows have, by
documents) and multiplies it from the left by the items' weights of these terms.
Weights and impacts are whole numbers, held in float64: a vocabulary tile is so
wide that no sum can reach 2^53, so BLAS may add in any order and stays exact;
sums of several tiles are added as 64-bit integers. A task keeps each item's best
of the tiles it has seen, of equal scores those of the least doc_id, and hands on
these alone.

Documents are never shuffled, only (item, document) winners. Items come in blocks
of about PAIRS (item, term) pairs, counted before, by a hash of their id; each block
is sent to all tasks and makes one pass. The vocabulary that is sent is so bounded.

Defined results: null and empty texts have no terms; a document without terms is
found by no item and doesn't count; an item without terms, or that no document
shares a term with, gives no row; a very long text is read whole, in its row's
memory; items with one item_id are one, with the terms of all their texts; repeated
documents are ranked each; of equal scores a null doc_id comes last; a null item_id
is an item, too; empty tables give an empty result. Other columns of both inputs,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import slices, stored, text_of
from plinth.llm.words import lowered_words

LIMIT = 10
#: (item, term) pairs of a block of items, about; documents and terms of a tile.
PAIRS, TILE, TERMS = 1 << 18, 512, 2048
#: Fixed values of the formula: scale of weights, of impacts, of lengths; what a length counts for, in percent; an impact's bound.
SCALE, PEAK, STEP, SHARE, BOUND = 1000, 1_000_000_000, 8, 90, 1_000_000
#: Parts in which an item's winners are first cut to its limit.
PARTS = 64


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), every pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                terms, first = lowered_words(part.column("text"))
                of = part.column("item_id").take(pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first))))
                yield pa.RecordBatch.from_arrays([of, terms], ["item_id", "term"])

    rows = items.select("item_id", text_of(items).alias("text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def counted(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, n (terms with repeats), and which of the given terms, by their place, it has how often; only documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(1, len(shared.value))
        for batch in batches:
            for part in slices(batch):
                found, first = lowered_words(part.column("text"))
                n = np.diff(first)
                at = pc.index_in(found, shared.value)
                known = np.asarray(pc.is_valid(at))
                row = np.repeat(np.arange(len(n)), n)[known]
                pair, tf = np.unique(row * wide + np.asarray(pc.drop_null(at), np.int64), return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * wide), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % wide, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "at", "tf"]).filter(pa.array(n > 0))

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, at array<int>, tf array<int>")


def frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many of the counted documents have each term: each task's counts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column("at").flatten().to_numpy(), minlength=n_terms)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["term", "df"])

    sums = rows.select("at").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block
    df = np.zeros(n_terms, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term counts for that stands tf times in a document of that m; below BOUND."""
    return (PEAK * tf) // (SCALE * tf + STEP * length)


def _best(pool: pa.Table, limit: int) -> pa.Table:
    """Each item's best rows of (item, score, doc_id), of equal scores those of the least doc_id, null last; in this order."""
    pool = pool.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = pool.column("item").to_numpy()
    return pool.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < limit))


def best_of_tiles(rows: DataFrame, items: pa.Array, pairs: tuple[np.ndarray, np.ndarray], weight: np.ndarray, n_docs: int, n_words: int, limit: int) -> DataFrame:
    """(item_id, doc_id, score, part): each task's best ``limit`` documents of every item with a score above 0.

    rows: counted documents; pairs: item and term numbers; weight: by term.
    """
    shared = rows.sparkSession.sparkContext.broadcast((items, *pairs, weight))
    width = max(1, min(TERMS, (1 << 53) // (BOUND * max(1, int(weight.max(initial=1))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, item, term, weight = shared.value
        tiles = []
        for low in range(0, len(weight), width):
            own = (term >= low) & (term < low + width)
            dense = np.zeros((len(items), min(width, len(weight) - low)))
            dense[item[own], term[own] - low] = weight[term[own]]
            tiles.append((low, dense))
        edge = np.ones(len(items), np.int64)  # the least score that an item can still use
        pool = None

        def kept(pool: pa.Table) -> pa.Table:
            pool = _best(pool, limit)
            full, n = np.unique(pool.column("item").to_numpy(), return_counts=True)
            last = np.cumsum(n) - 1
            full, last = full[n == limit], last[n == limit]
            edge[full] = np.maximum(edge[full], pool.column("score").to_numpy()[last])
            return pool

        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                sizes = np.asarray(pc.list_value_length(part.column("at")))
                at, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "tf"))
                doc = np.repeat(np.arange(part.num_rows), sizes)
                m = np.array([100 - SHARE + SHARE * n * n_docs // n_words for n in part.column("n").to_pylist()], np.int64)
                impact = impacts(tf, m[doc])
                scores = np.zeros((len(items), part.num_rows), np.int64)
                for low, dense in tiles:
                    own = (at >= low) & (at < low + dense.shape[1])
                    used, place = np.unique(at[own] - low, return_inverse=True)
                    tile = np.zeros((len(used), part.num_rows))
                    tile[place, doc[own]] = impact[own]
                    scores += (dense[:, used] @ tile).astype(np.int64)
                i, d = np.nonzero(scores >= edge[:, None])
                new = pa.table({"item": pa.array(i), "score": pa.array(scores[i, d]), "doc_id": part.column("doc_id").take(pa.array(d))})
                pool = new if pool is None else pa.concat_tables([pool, new])
                if pool.num_rows > 2 * limit * len(items) + TILE:
                    pool = kept(pool)
        if pool is not None and pool.num_rows and limit:
            pool = _best(pool, limit).combine_chunks()
            task = pa.array(np.full(pool.num_rows, TaskContext.get().partitionId() % PARTS, np.int32))
            named = items.take(pool.column("item").combine_chunks())
            yield from pa.table([named, pool.column("doc_id"), pool.column("score"), task], names=["item_id", "doc_id", "score", "part"]).to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {_spark_type(items.type)}, doc_id {kind}, score long, part int")


def _spark_type(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def _ranked(found: DataFrame, limit: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item_id", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``limit`` best documents with a score above 0, ties by doc_id."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    pairs = stored(item_terms(items), "pairs")
    blocks = max(1, -(-pairs.count() // PAIRS))
    found = [_search_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), limit) for k in range(blocks)]
    best = _ranked(functools.reduce(DataFrame.union, found), limit, "part")
    return _ranked(best, limit).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """The tasks' winners for one block of items."""
    own = pairs.toArrow().combine_chunks()  # about PAIRS rows
    items, terms = (pc.unique(own.column(c)) for c in ("item_id", "term"))
    items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
    item, term = (np.asarray(pc.index_in(own.column(c), x), np.int64) for c, x in (("item_id", items), ("term", terms)))
    rows = stored(counted(docs, terms), "counted")
    n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(n_docs, frequencies(rows, len(terms)))
    return stored(best_of_tiles(rows, items, (item, term), weight, n_docs, n_words, limit), "winners")


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, {_TERMS}) terms from documents
), total as (
  select count(*) n, sum(len(terms))::bigint l from d where len(terms) > 0
), q as (
  select distinct item_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) term from benchmark
), p as (
  select rid, doc_id, len(terms)::bigint n, unnest(terms) term from d
), tf as (
  select rid, doc_id, n, term, count(*)::bigint tf from p where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln(((2 * (select n from total) + 2)::double) / (2 * count(*) + 1)::double))::bigint w from tf group by term
), s as (
  select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * tf.n * total.n) // total.l)))))::bigint score
  from q join tf using (term) join w using (term), total group by item_id, rid, doc_id
)
select item_id, rank::int rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0) where rank <= {LIMIT}"""

"""A stored inverted index: chunks are tokenised once, searches read only the postings of their tokens.

An index is a folder of three tables:

    chunks    number, chunk_id, length (in tokens)
    postings  bucket=B/: block, tokens (joined by blanks), facts (of each token: how many chunks have it, its greatest count in one, their
              least length), and entries (places of these chunks, counts in them); each kind of number packed for itself
    stats     one row, written last: an index without it isn't there

A chunk's number tells the task that counted it and its place there; BLOCK numbers
in a row are a block. A row of the postings holds the tokens of one bucket, by a
hash, that one block has, so no row grows with the corpus. How much a chunk of it can
score at most for a token follows from the token's greatest count and the least
length, whatever the parameters. Such rows are made where the chunks are read, in one
pass over the texts, and written before anything is shuffled (a block that two batches
share has two rows, which changes no sum); Spark sees a few packed values of a row, not its
tokens. They are then dealt into files by bucket, large buckets into several.

A search reads the buckets of its tokens alone. It first reads no lists, only what
bounds them: each query's greatest possible score in each block is a sum over its
tokens. The FIRST blocks of each query, by that bound, are scored in full, which
gives a threshold, the score of the last result so far; other blocks are scored only
where their bound reaches it. Results are those of scoring every chunk. The postings
of GROUP blocks meet in one task, which adds up the scores of their chunks for all
queries in arrays and hands on each query's best. Queries come in blocks by a hash
of their id where their tokens are too many to be sent to all tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.batches import slices
from plinth.functions.words import word_points, words
from plinth.operators.retrieval import K1, B, best_of, check_limit, query_tokens, top
from plinth.sources.shared import new_folder, sent, stored

#: Numbers of a block, buckets that tokens are dealt into, blocks of a query that are scored before there is a threshold.
BLOCK, BUCKETS, FIRST = 1024, 64, 2
#: Blocks of a group, postings that are spelled out for their queries at once, (query, token) pairs of a block of queries, about.
GROUP, STEP, PAIRS = 2, 1 << 14, 1 << 18
#: Bytes of tokens of the postings that are read at once.
READ = 1 << 20
#: What a block knows of a token: its chunks that have it, the greatest count, the least length of these chunks.
FACTS = {"n": np.dtype("<u4"), "most_tf": np.dtype("<u4"), "least_length": np.dtype("<u4")}
#: Each chunk's place in its block, and the token's count in it.
ENTRIES = {"place": np.dtype("<u2"), "tf": np.dtype("<u4")}
#: The facts of a token of a search, and its place among the search's tokens.
HELD = {"at": np.dtype("<u4")} | FACTS
#: What sums of the same numbers in another order may differ by.
SLACK = 1e-7
#: Of counts in chunk and length, what a token counts for; of counts in query and corpus, its weight.
Formula = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _kind(packed: dict[str, np.dtype]) -> str:
    return f"struct<{','.join(f'{name}:binary' for name in packed)}>"


_POSTINGS = f"bucket int, block long, tokens string, facts {_kind(FACTS)}, entries {_kind(ENTRIES)}"


def _buckets(tokens_: pa.Array, buckets: int) -> np.ndarray:
    return (hash_array(tokens_.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)


def _packed(kinds: dict[str, np.dtype], ends: np.ndarray, *columns: np.ndarray) -> pa.StructArray:
    """Pieces of columns of numbers that end at ``ends``, as bytes; equal kinds of numbers stand together, as they shrink best."""

    def pieces(kind: np.dtype, values: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(values, kind)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((kind.itemsize * ends).astype(np.int32)), pa.py_buffer(data)])

    return pa.StructArray.from_arrays([pieces(k, v) for k, v in zip(kinds.values(), columns, strict=True)], list(kinds))


def _unpacked(kinds: dict[str, np.dtype], packed: pa.StructArray | pa.ChunkedArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The numbers of all rows by name, and how many of them each row has."""
    fields = {name: pc.struct_field(packed, name) for name in kinds}
    first, kind = next(iter(kinds.items()))
    return {name: np.frombuffer(b"".join(fields[name].to_pylist()), k) for name, k in kinds.items()}, np.asarray(pc.binary_length(fields[first])) // kind.itemsize


def _bits(n: int) -> int:
    return max(0, n - 1).bit_length()


def _inverted(chunks: DataFrame, buckets: int) -> DataFrame:
    """number, chunk_id and length of each chunk, and rows of the postings: one for each bucket and block that a slice of a batch has."""

    def invert(lists: pa.ListArray, number: np.ndarray) -> list[pa.Array] | None:
        """Columns of the postings; one sort brings the tokens of all chunks into the order of block, bucket, token and chunk."""
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return None
        sizes = np.asarray(pc.list_value_length(lists), np.int64)
        bucket = _buckets(coded.dictionary, buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        code = np.empty(len(by_bucket), np.int64)
        code[by_bucket] = np.arange(len(by_bucket))
        rows, wide = _bits(len(lists)), _bits(len(by_bucket))
        first = number // BLOCK - number[0] // BLOCK
        key = np.repeat((first << (wide + rows)) + np.arange(len(lists)), sizes)
        key += code[coded.indices.to_numpy()] << rows
        key.sort()
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf, key = np.diff(np.append(fresh, len(key))), key[fresh]
        row, word = key & ((1 << rows) - 1), key >> rows
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # where a token's entries begin
        token, block = by_bucket[word[starts] & ((1 << wide) - 1)], word[starts] >> wide
        facts = np.diff(np.append(starts, len(key))), np.maximum.reduceat(tf, starts), np.minimum.reduceat(sizes[row], starts)
        own = bucket[token]
        at = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])))  # which tokens begin a row
        ends = np.append(at, len(starts))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(token))), " ")
        return [pa.array(own[at].astype(np.int32)), pa.array(block[at] + number[0] // BLOCK), joined, _packed(FACTS, ends, *facts), _packed(ENTRIES, np.append(starts[at], len(key)), number[row] % BLOCK, tf)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch)):
            number, lists = np.arange(begin, begin + part.num_rows), words(part.column("text"), shared.value)
            begin += part.num_rows
            own = [pa.array(number), part.column("chunk_id"), pc.list_value_length(lists)]
            found = invert(lists, number)
            none = [pa.int32(), pa.int64(), pa.string(), *(pa.struct([(name, pa.binary()) for name in kinds]) for kinds in (FACTS, ENTRIES))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(number), kind) for kind in none)], names)
            if found is not None:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(found[0]), c.type) for c in own), *found], names)

    shared = chunks.sparkSession.sparkContext.broadcast(word_points(chunks.sparkSession))
    rows = chunks.select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    names = ["number", "chunk_id", "length", "bucket", "block", "tokens", "facts", "entries"]
    return rows.mapInArrow(run, f"number long, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, length int, {_POSTINGS}")


def _distinct(postings: DataFrame) -> DataFrame:
    """One row: the tokens of all postings, each once; a slice of the rows names each of its tokens once before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "tokens")):
            yield pa.RecordBatch.from_arrays([pc.unique(pc.split_pattern(part.column("tokens"), " ").flatten())], ["token"])

    return postings.select("tokens").mapInArrow(run, "token string").distinct().agg(F.count("*").alias("n_distinct"))


def write(chunks: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> str:
    """Writes an index of chunks (chunk_id, text) and returns its folder, a new one under the shared folder if none is named.

    Null text has no tokens; repeated rows are chunks of their own.
    """
    spark = chunks.sparkSession
    folder = folder or new_folder(spark, "index")
    made = stored(_inverted(chunks, buckets), "inverted")
    made.where(F.col("number").isNotNull()).select("number", "chunk_id", "length").write.option("compression", "zstd").parquet(f"{folder}/chunks")
    rows, key = made.where(F.col("number").isNull()).select("bucket", "block", "tokens", "facts", "entries"), ["bucket", "block"]
    rows.hint("rebalance", "bucket").sortWithinPartitions(*key).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    sums = spark.read.parquet(f"{folder}/chunks").agg(F.count("*").alias("n_chunks"), F.avg("length").alias("avg_length"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))
    seen = _distinct(spark.read.schema(_POSTINGS).parquet(f"{folder}/postings"))
    stats = sums.join(seen).withColumn("buckets", F.lit(buckets))  # a row each
    stats.coalesce(1).write.parquet(f"{folder}/stats")
    return folder


@dataclass
class Index:
    """An index that ``write`` has written. ``report`` says of the last search how many (query, block) pairs there were and were scored."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.stats = self.spark.read.parquet(f"{self.folder}/stats")  # an error where the index is unfinished
        self._row = self.stats.first()
        self.report: dict[str, int] = {}

    @property
    def chunks(self) -> DataFrame:
        """number, chunk_id and length; the texts' tokens stay unread."""
        return self.spark.read.parquet(f"{self.folder}/chunks").select("number", "chunk_id", "length")

    def postings(self, words: pa.Array, blocks: DataFrame | None = None, entries: bool = False) -> DataFrame:
        """The postings of some tokens: block, and packed as ``held`` the places in the list of those that a row has, with what bounds them;
        and their entries where they are asked for, else they stay unread; only some blocks, where given. Other buckets' files aren't opened."""
        own = sorted(set(_buckets(words, self._row["buckets"]).tolist()))
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings").where(F.col("bucket").isin(own))
        rows = rows if blocks is None else rows.join(blocks, "block", "left_semi")
        shared = self.spark.sparkContext.broadcast(words)
        more = ["entries"] if entries else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in slices(batch, "tokens", READ)):
                lists = pc.split_pattern(part.column("tokens"), " ")
                at = pc.index_in(lists.flatten(), shared.value)
                known = np.asarray(pc.is_valid(at))
                row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))[known]
                facts, _ = _unpacked(FACTS, part.column("facts"))
                own = {name: x[known] for name, x in facts.items()}
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])  # where a row's tokens begin
                ends = np.append(first, len(row))
                columns = [part.column("block").take(pa.array(row[first])), _packed(HELD, ends, np.asarray(pc.drop_null(at)), *own.values())]
                if entries:
                    lists, kept = _unpacked(ENTRIES, part.column("entries"))[0], np.repeat(known, facts["n"])
                    columns.append(_packed(ENTRIES, np.append(0, np.cumsum(own["n"], dtype=np.int64))[ends], *(x[kept] for x in lists.values())))
                yield pa.RecordBatch.from_arrays(columns, ["block", "held", *more])

        return rows.select("block", "tokens", "facts", *more).mapInArrow(run, f"block long, held {_kind(HELD)}" + (f", entries {_kind(ENTRIES)}" if entries else ""))

    def statistics(self) -> DataFrame:
        """As retrieval.corpus_statistics, without reading a text."""
        return self.stats.select("n_chunks", "avg_length", "n_tokens", "n_distinct")

    def bm25(self, queries: DataFrame, limit: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """As retrieval.bm25_search over the chunks of the index."""
        average, n_chunks = self._row["avg_length"] or 0.0, self._row["n_chunks"]

        def part(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / average if average > 0 else 0.0)))

        def weight(qtf: np.ndarray, df: np.ndarray) -> np.ndarray:
            return qtf * np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))

        return self._search(queries, limit, part, weight)

    def lexical(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """As retrieval.lexical_search over the chunks of the index."""
        return self._search(queries, limit, lambda tf, _: tf.astype(np.float64), lambda qtf, _: np.ones(len(qtf)))

    def _search(self, queries: DataFrame, limit: int, part: Formula, weight: Formula) -> DataFrame:
        check_limit(limit)
        wanted = stored(query_tokens(queries), "wanted")
        blocks, self.report = max(1, -(-wanted.count() // PAIRS)), {"pairs": 0, "scored": 0}
        found = [self._block(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), limit, part, weight) for k in range(blocks)]
        return functools.reduce(DataFrame.union, found)

    def _block(self, wanted: DataFrame, limit: int, part: Formula, weight: Formula) -> DataFrame:
        """(query_id, rank, chunk_id, score) of a block of queries."""
        rows = wanted.toArrow().combine_chunks()  # about PAIRS rows
        asked, words = (pc.unique(rows.column(c)) for c in ("query_id", "token"))
        query, token = (np.asarray(pc.index_in(rows.column(c), x), np.int64) for c, x in (("query_id", asked), ("token", words)))
        asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        postings = stored(self.postings(words), "held")

        def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, _ = _unpacked(HELD, batch.column("held"))
                at, place = np.unique(held["at"], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.bincount(place, held["n"], len(at)).astype(np.int64))], ["at", "n"])

        sums = postings.select("held").mapInArrow(having, "at long, n long").groupBy("at").agg(F.sum("n").alias("df")).toArrow()  # a row for each token of the block
        df = np.zeros(len(words))
        df[sums.column("at").to_numpy()] = sums.column("df").to_numpy()
        order = np.argsort(token, kind="stable")
        weights = weight(rows.column("qtf").to_numpy().astype(np.float64), df[token])[order]
        shared = self.spark.sparkContext.broadcast((query[order], np.searchsorted(token[order], np.arange(len(words) + 1)), weights))

        def asking(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """The places in ``at``, the queries that have its tokens, and the weights, a step at a time."""
            query, starts, weight = shared.value
            for first in range(0, len(at), STEP):
                own = at[first : first + STEP]
                n = starts[own + 1] - starts[own]
                ends = np.cumsum(n)
                pick = np.repeat(starts[own] - ends + n, n) + np.arange(int(ends[-1]))
                yield first + np.repeat(np.arange(len(own)), n), query[pick], weight[pick]

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, n = _unpacked(HELD, batch.column("held"))
                most, row = part(held["most_tf"].astype(np.float64), held["least_length"].astype(np.float64)), np.repeat(np.arange(batch.num_rows), n)
                for place, who, w in asking(held["at"]):
                    yield pa.RecordBatch.from_arrays([pa.array(who), batch.column("block").take(pa.array(row[place])), pa.array(w * most[place])], ["query", "block", "bound"])

        bounds = postings.mapInArrow(bound, "query long, block long, bound double")
        bounds = stored(bounds.groupBy("query", "block").agg(F.sum("bound").alias("bound")), "bounds")
        n_asked, kind = len(asked), self.chunks.schema["chunk_id"].dataType.simpleString()

        def score(rows: pa.Table, pairs: pa.Table) -> pa.Table:
            blocks = np.unique(pairs.column("block").to_numpy())
            rows = rows.filter(pc.is_in(rows.column("block"), pa.array(blocks))).combine_chunks()
            chunks, postings = rows.filter(pc.is_valid(rows.column("number"))).sort_by("chunk_id"), rows.filter(pc.is_null(rows.column("number")))
            number, slot = chunks.column("number").to_numpy(), np.argsort(chunks.column("number").to_numpy())  # slots are in the order of the ids
            known, n = _unpacked(HELD, postings.column("held"))
            entries, _ = _unpacked(ENTRIES, postings.column("entries"))
            held = np.repeat(np.repeat(postings.column("block").to_numpy(), n) * BLOCK, known["n"]) + entries["place"]
            place_of = slot[np.searchsorted(number, held, sorter=slot)] if len(held) else held
            at = np.repeat(known["at"], known["n"])
            parts, scores = part(entries["tf"].astype(np.float64), chunks.column("length").to_numpy().astype(np.float64)[place_of]), np.zeros((n_asked, len(number)))
            for place, who, w in asking(at):
                scores += np.bincount(who * len(number) + place_of[place], w * parts[place], scores.size).reshape(scores.shape)
            wanted = np.zeros((n_asked, len(blocks)), bool)
            wanted[pairs.column("query").to_numpy(), np.searchsorted(blocks, pairs.column("block").to_numpy())] = True
            scores[~wanted[:, np.searchsorted(blocks, number // BLOCK)]] = 0
            q, c = best_of(scores, min(limit, len(number))) if limit and scores.size else (np.empty(0, np.int64),) * 2
            some = scores[q, c] > 0
            q, c = q[some], c[some]
            return pa.table({"query": pa.array(q), "chunk_id": chunks.column("chunk_id").take(pa.array(c)), "score": pa.array(scores[q, c])})

        def scored(pairs: DataFrame) -> DataFrame:
            """Scores of the pairs' blocks; the ids and lengths of their chunks come as rows without a token."""
            group, blocks = F.floor(F.col("block") / GROUP).alias("group"), sent(stored(pairs.select("block").distinct(), "blocks"))
            ids = self.chunks.select(F.floor(F.col("number") / BLOCK).alias("block"), "number", "chunk_id", "length").join(blocks, "block", "left_semi")
            lists = self.postings(words, blocks, entries=True)
            rows = lists.unionByName(ids, allowMissingColumns=True).select("*", group).groupBy("group")
            return rows.cogroup(pairs.select(group, "query", "block").groupBy("group")).applyInArrow(score, f"query long, chunk_id {kind}, score double")

        def best(found: DataFrame) -> DataFrame:
            return top(found.withColumnRenamed("query", "query_id"), limit).withColumnRenamed("query_id", "query")

        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
        first = stored(bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query", "block"), "first")
        early = stored(best(scored(first)), "early")
        reached = early.where(F.col("rank") == limit).select("query", F.col("score").alias("threshold"))
        rest = bounds.join(first, ["query", "block"], "left_anti").join(F.broadcast(reached), "query", "left")  # a row for each query
        rest = stored(rest.where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK)).select("query", "block"), "rest")
        self.report["pairs"] += bounds.count()
        self.report["scored"] += first.count() + rest.count()
        names = F.broadcast(self.spark.createDataFrame(pa.table({"query": pa.array(np.arange(n_asked)), "query_id": asked})))
        both = best(early.select("query", "chunk_id", "score").union(scored(rest)))
        return both.join(names, "query").select("query_id", "rank", "chunk_id", "score")

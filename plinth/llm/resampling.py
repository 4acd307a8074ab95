"""Importance resampling towards a target distribution: hashed word runs, Gumbel keys, distributed quickselect.

Texts become features: all runs of 1 to RUN words, each hashed into one of BUCKETS
buckets. Counts of the buckets over all documents and over all target texts are
sums of each task's arrays; a bucket's gain is the logarithm of their ratio, in
thousandths, and a document's weight is the sum of its features' gains. A Gumbel
number that the document's id seeds is added, so that the highest scores are a draw
without replacement by weight.

The draw takes the k highest of N eligible documents. No sort finds them: the rows
are written once, told apart by a composite key (score, doc_id, features, file and
place); each round takes PIVOTS keys of the remaining interval at random, and one
aggregation counts exactly how many keys come before each pivot and how many equal
it, which narrows the interval until a pivot is the k-th key itself. The winners
alone are then sorted, in ranges, and ranked; all others stay as they were written.

Defined results: a null or empty text has no features, weight 0, and isn't
eligible; a very long text is read whole, in its row's memory; of rows alike in
score and doc_id, those of fewer features come first, and of rows alike in all three
any; a null doc_id seeds with the word null and comes last of equal scores; repeated
rows are drawn each; an empty table gives an empty result, an empty target gains
from zero counts. Other columns of both inputs, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, stored, text_of
from plinth.llm.words import lowered_words
from plinth.operators.numbering import numbered

#: Words of a feature at most, buckets, words of an eligible document at least, percent of these that are drawn, seed.
RUN, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Pivots of one round.
PIVOTS = 15
#: Distinct features whose bucket a task remembers.
KNOWN = 1 << 19


class Hasher:
    """Buckets of the features of many texts; a distinct feature is hashed once while it is remembered."""

    def __init__(self, run: int, buckets: int):
        self.run, self.buckets, self.known = run, buckets, {}

    def _hashed(self, features: list[str]) -> np.ndarray:
        known = self.known
        if len(known) + len(features) > KNOWN:
            known.clear()
        for f in features:
            if f not in known:
                known[f] = zlib.crc32(f.encode()) % self.buckets
        return np.fromiter((known[f] for f in features), np.int64, len(features))

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of rows and of their features' buckets, one pair for each length of runs, with the rows' numbers of words."""
        words, first = lowered_words(texts)
        sizes = np.diff(first)
        row = np.repeat(np.arange(len(sizes)), sizes)
        joined = words
        for n in range(1, self.run + 1):
            if n > 1:
                joined = pc.binary_join_element_wise(joined[:-1], words[n - 1 :], " ") if len(words) >= n else words[:0]
            whole = row[: len(joined)] == row[n - 1 :] if len(joined) else np.empty(0, bool)
            coded = (joined if n == 1 else joined.filter(pa.array(whole))).dictionary_encode()
            buckets = self._hashed(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
            yield row[: len(joined)][whole], buckets, sizes


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: each task's array, summed; one number a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(run, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, own, _ in hasher(part.column("text")):
                    seen += np.bincount(own, minlength=buckets)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["bucket", "n"])

    sums = texts.select(text_of(texts).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (t + 1) (S + buckets) / ((s + 1) (T + buckets))) of every bucket."""
    s_all, t_all = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        hasher = Hasher(run, len(gain))
        for batch in batches:
            for part in slices(batch):
                n, weight, sizes = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), None
                for row, own, sizes in hasher(part.column("text")):  # noqa: B007
                    n += np.bincount(row, minlength=part.num_rows)
                    before = np.append(0, np.cumsum(gain[own]))  # whole numbers all through; rows are in order
                    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                    weight += before[bounds[1:]] - before[bounds[:-1]]
                noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in part.column("h").to_pylist()]
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(weight), pa.array(weight + np.array(noise, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", text_of(docs).alias("text"), h.alias("h"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def _key() -> Column:
    """The composite key of a stored row: the order of the draw, and no two rows alike."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_features", "file", "place")


def kth_key(rows: DataFrame, k: int, seed: int = SEED):
    """The k-th least (from 1) ``key`` of rows, by distributed quickselect; null where rows are fewer.

    A round draws pivots from the open interval that still holds it, and counts exactly the keys before and at each pivot.
    """
    kind = rows.schema["key"].dataType.simpleString()
    low, high, below, step = None, None, 0, 0  # the interval's ends, outside of it, and how many keys are not above its low end

    def lit(key: str) -> Column:
        return F.from_json(F.lit(key), kind)

    while True:
        inside = rows
        if low is not None:
            inside = inside.where(F.col("key") > lit(low))
        if high is not None:
            inside = inside.where(F.col("key") < lit(high))
        drawn = inside.orderBy(F.xxhash64("key", F.lit(seed + step))).limit(PIVOTS)
        pivots = [r.json for r in drawn.orderBy("key").select(F.to_json("key", {"ignoreNullFields": "false"}).alias("json")).collect()]
        if not pivots:
            return None
        counts = inside.agg(*(c for p in pivots for c in (F.count_if(F.col("key") < lit(p)), F.count_if(F.col("key") == lit(p))))).first()
        passed = 0
        for pivot, before, equal in zip(pivots, counts[::2], counts[1::2], strict=True):
            if k <= below + before:
                high = pivot
                break
            if k <= below + before + equal:
                return pivot
            low, passed = pivot, before + equal
        below += passed
        step += 1


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of docs: doc_id, n_features, weight, score, and its rank in the draw, null where it isn't drawn."""
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    rows = stored(weighed(docs, gain, run, seed), "weighed")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    eligible = F.col("n_words") >= least
    n = rows.where(eligible).count()
    keyed = rows.withColumn("key", _key())
    edge = kth_key(keyed.where(eligible), percent * n // 100, seed) if percent * n // 100 else None
    columns = ["doc_id", "n_features", "weight", "score"]
    if edge is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = eligible & (F.col("key") <= F.from_json(F.lit(edge), keyed.schema["key"].dataType.simpleString()))
    winners = numbered(keyed.where(drawn).select(*columns, "key"), "key", name="rank").select(*columns, (F.col("rank") + 1).alias("rank"))
    return winners.unionByName(keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (
  select row_number() over () rid, doc_id, {_WORDS} words from documents
), b as (
  select {_WORDS} words from benchmark
), vocabulary as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::bigint) % {BUCKETS} bucket
  from (select distinct unnest(words) word from (select words from d union all select words from b))
), dw as (select rid, unnest(words) word from d
), s as (select bucket, count(*) n from dw join vocabulary using (word) group by bucket
), t as (select bucket, count(*) n from (select unnest(words) word from b) join vocabulary using (word) group by bucket
), gain as (
  select bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + {BUCKETS}))::double / ((s.n + 1) * ((select coalesce(sum(n), 0) from t) + {BUCKETS}))::double))::bigint gain
  from s left join t using (bucket)
), w as (select rid, sum(gain)::bigint weight from dw join vocabulary using (word) join gain using (bucket) group by rid
), scored as (
  select rid, doc_id, len(words)::bigint n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint score
  from d left join w using (rid)
), ranked as (
  select rid, row_number() over (order by score desc, doc_id) rank, count(*) over () n from scored where n_features >= {LEAST}
)
select doc_id, n_features, weight, score, case when rank <= {PERCENT} * n // 100 then rank end rank from scored left join ranked using (rid)"""

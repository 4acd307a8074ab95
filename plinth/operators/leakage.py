"""Leakage checks: texts of one side that the other side holds too, by id, whole, or nearly.

Near matches are exact: every pair of different texts whose sets of word shingles
have a Jaccard similarity of at least ``least`` is found, without comparing all with
all. Equal sets are taken once (a class), so copies never meet each other. Shingles
are put in the order of how rare they are, counted in BUCKETS by their hashes (any order
that both sides share is exact; a rough one meets a few more pairs); two sets that are
similar enough must share one of the first few, the prefix, so only prefixes are
shuffled, and each pair that meets is then compared in full, from the sets as they were
stored. A class' prefix is as long as its size demands and no longer; pairs whose sizes
or places leave room for too few shingles in common are passed over before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import let, tokens
from plinth.sources.shared import sent, stored

#: Words of a shingle, and the similarity from which two texts are near.
WORDS, LEAST = 5, 0.8
#: Buckets in which shingles are counted, and sets that are put in order at once.
BUCKETS, ORDERED = 1 << 18, 256
#: What tells classes apart: two hashes of the set and its size, on either side.
CLASS = ["held", "k1", "k2", "size"]


def shingles(text: Column, n: int = WORDS) -> Column:
    """The distinct hashes of a text's runs of n words; of fewer words, the whole."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(many))).otherwise(F.array().cast("array<bigint>"))

    return let(F.coalesce(tokens(text), F.array().cast("array<string>")), runs)


def _shingled(texts: DataFrame, n: int) -> DataFrame:
    """Texts (id, text, held) stored once without their text: a digest of it, the set of its shingles, its class, and a number (row)."""
    rows = texts.select("held", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), shingles(F.col("text"), n).alias("set"))
    rows = rows.select("*", F.xxhash64("set").alias("k1"), F.hash("set").alias("k2"), F.size("set").alias("size"), F.monotonically_increasing_id().alias("row"))
    return stored(rows, "shingles")


def _counts(rows: DataFrame) -> np.ndarray:
    """How many shingles each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("set").flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    found = rows.select("set").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """The classes of rows with shingles: what tells them apart, the first of their rows (class), and the prefix of their set."""
    shared = rows.sparkSession.sparkContext.broadcast(_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ORDERED) for whole in batches for i in range(0, whole.num_rows, ORDERED)):
            size = np.asarray(pc.list_value_length(batch.column("set")), np.int64)
            s, own = batch.column("set").flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            s = s[np.lexsort((s, shared.value[s & (BUCKETS - 1)], own))]
            length = size - np.ceil(size * least - 1e-9).astype(np.int64) + 1
            ends = np.concatenate([[0], np.cumsum(length)])
            s = s[np.arange(len(s)) - (np.cumsum(size) - size)[own] < length[own]]
            columns = [*(batch.column(c) for c in (*CLASS, "row")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s))]
            yield pa.RecordBatch.from_arrays(columns, [*CLASS, "row", "prefix"])

    made = rows.where("size > 0").select(*CLASS, "row", "set").mapInArrow(run, "held boolean, k1 long, k2 int, size int, row long, prefix array<long>")
    return made.groupBy(*CLASS).agg(F.min("row").alias("class"), F.any_value("prefix").alias("prefix"))


def near_matches(rows: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (left_class, right_class, similarity) of stored rows, held ones left, others right, and the classes.

    A class stands for all texts with the same shingles; equal ones have a similarity of 1.
    """
    classes = stored(_classes(rows, least), "classes")
    at = classes.select("held", "class", "size", F.posexplode("prefix").alias("place", "s"))
    a, b = (at.where(F.col("held") == held).select("s", *(F.col(c).alias(f"{name}_{c}") for c in ("class", "size", "place"))) for held, name in ((True, "left"), (False, "right")))
    room = F.least(F.col("left_size") - F.col("left_place"), F.col("right_size") - F.col("right_place"))  # in common at most, if this is the first
    near = (F.least("left_size", "right_size") >= F.greatest("left_size", "right_size") * least - 1e-9) & (room >= (F.col("left_size") + F.col("right_size")) * (least / (1 + least)) - 1e-9)
    pairs = stored(a.join(b, "s").where(near).select("left_class", "right_class").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("left_class", "right_class")).alias("row")).distinct()
    sets = stored(rows.select("row", "set").join(sent(wanted), "row", "left_semi"), "sets")
    full = pairs.join(sets.select(F.col("row").alias("left_class"), F.col("set").alias("left_set")), "left_class")
    full = full.join(sets.select(F.col("row").alias("right_class"), F.col("set").alias("right_set")), "right_class")
    shared = F.size(F.array_intersect("left_set", "right_set"))
    similarity = shared / (F.size("left_set") + F.size("right_set") - shared)
    found = full.select("left_class", "right_class", similarity.alias("similarity")).where(F.col("similarity") >= least - 1e-12)
    return found, classes.drop("prefix")


def leakage(heldout: DataFrame, others: DataFrame, n: int = WORDS, least: float = LEAST) -> DataFrame:
    """For each held-out text (id, text) whether its id is among the others', how many others have its whole text, how many are near it by
    their shingles (equal sets counted), and the highest similarity, null where none is near. Null texts are empty; empty ones are near none."""
    sides = (side.select("id", "text").withColumn("held", F.lit(held)) for side, held in ((heldout, True), (others, False)))
    return marked_leakage(next(sides).unionByName(next(sides)), n, least)


def marked_leakage(texts: DataFrame, n: int = WORDS, least: float = LEAST) -> DataFrame:
    """As ``leakage``, of texts (id, text, held) that are marked as held out or not."""
    rows = _shingled(texts, n)
    found, classes = near_matches(rows, least)
    held, others = (rows.where(F.col("held") == side).drop("set") for side in (True, False))
    sizes = others.groupBy(*CLASS).agg(F.count("*").alias("n")).join(classes, CLASS).select(F.col("class").alias("right_class"), "n")
    near = found.join(sizes, "right_class").groupBy("left_class").agg(F.sum("n").alias("n_near"), F.max("similarity").alias("closest"))
    near = classes.join(near, classes["class"] == near["left_class"]).select(*CLASS, "n_near", "closest")
    equal = others.groupBy("h").agg(F.count("*").alias("n_equal"))
    same = others.select("id").distinct().withColumn("same_id", F.lit(True))
    out = held.join(equal, "h", "left").join(near, CLASS, "left").join(same, "id", "left")
    return out.select("id", F.coalesce("same_id", F.lit(False)).alias("same_id"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "closest")

"""Exact percentiles of groups of any size, by selection instead of sorting.

A group of up to SMALL values is worked out in its own row. Of a larger one, only
the values at the wanted ranks are sought, all groups at once: each round takes
PIVOTS values of the interval that still holds a rank from mergeable sketches,
counts exactly how many values lie between and at them, and goes on with the one
interval that the rank falls into, ends excluded, or is done where it falls on a
pivot. An interval of up to SMALL values is sorted in its row. So no task ever
holds a group, whatever its values, ties or outliers; sketches only guide the
search, the counts decide.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.sources.shared import sent, stored

#: Values of a group, or of an interval, that one row may hold; pivots of a round.
SMALL, PIVOTS = 10_000, 100


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys that may be null; b's keys are dropped."""
    named = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return a.join(named, on, how).drop(*(f"__{k}" for k in keys))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """A row for each group, null keys too: ``n``, values that aren't null, and a column for each share (0 to 1), by name.

    Between two values, a percentile divides them in proportion; a group without values has nulls. Without ``by`` all rows are one
    group, also where there are none.
    """
    if any(not 0 <= s <= 1 for s in shares.values()):
        raise ValueError("shares must lie between 0 and 1")
    names = [f"__key{i}" for i in range(len(by))]  # a group's column may bear any name, also one that the search uses
    given = stored(rows.select(*(F.col(k).alias(n) for k, n in zip(by, names, strict=True)), F.col(value).cast("double").alias("__v")), "values")
    return _grouped(given, shares, names).withColumnsRenamed(dict(zip(names, by, strict=True)))


def _grouped(given: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """The percentiles of all groups of rows (keys, __v)."""
    sizes = given.groupBy(*keys).agg(F.count("__v").alias("n"))
    large = stored(sizes.where(F.col("n") > SMALL), "large")
    plain = [F.percentile("__v", F.lit(s)).alias(name) for name, s in shares.items()]
    if large.isEmpty():
        return given.groupBy(*keys).agg(F.count("__v").alias("n"), *plain)
    values = given.where("__v is not null")
    found = _selected(values, large, shares, keys)
    if not keys:
        return found
    small = joined(given, sent(large.select(*keys)), keys, "left_anti").groupBy(*keys).agg(F.count("__v").alias("n"), *plain)
    return small.unionByName(found)


def _selected(values: DataFrame, large: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """The percentiles of groups (keys, n), all of them large, in rows (keys, __v) without nulls."""
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(s)) * (F.col("n") - 1)).alias("place")) for name, s in shares.items()))
    places = large.select(*keys, "n", F.explode(wanted).alias("w")).select(*keys, "n", "w.*")
    ends = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    targets = places.select(*keys, F.explode(ends).alias("rank"), "n").distinct()
    nothing = F.lit(None).cast("double")
    open_ = stored(targets.select(*keys, "rank", F.col("rank").alias("left"), F.col("n").alias("m"), nothing.alias("low"), nothing.alias("high")), "open")
    target, done = [*keys, "rank"], []
    while True:
        few = open_.where(F.col("m") <= SMALL)
        inside = (F.col("low").isNull() | (F.col("__v") > F.col("low"))) & (F.col("high").isNull() | (F.col("__v") < F.col("high")))
        held = joined(values, sent(few), keys).where(inside).groupBy(*target, "left").agg(F.sort_array(F.collect_list("__v")).alias("all"))
        done.append(stored(held.select(*target, F.element_at("all", F.col("left").cast("int") + 1).alias("value")), "done"))
        rest = open_.where(F.col("m") > SMALL)
        if rest.isEmpty():
            break
        held = joined(values, sent(rest), keys).where(inside)
        pivots = F.array_distinct(F.percentile_approx("__v", [i / (PIVOTS - 1) for i in range(PIVOTS)], F.lit(10 * PIVOTS)))
        drawn = stored(held.groupBy(*target, "left", "low", "high").agg(pivots.alias("pivots")), "pivots")
        held = joined(values, sent(drawn), keys).where(inside)
        below = F.size(F.filter("pivots", lambda p: p <= F.col("__v")))
        held = held.withColumn("bin", below).withColumn("apart", (F.col("bin") == 0) | (F.element_at("pivots", F.greatest("bin", F.lit(1))) != F.col("__v")))
        counts = held.groupBy(*target, "bin", "apart").agg(F.count("*").alias("m"))
        before = Window.partitionBy(*target).orderBy("bin", "apart").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))  # 2 * PIVOTS + 1 rows at most
        hit = joined(counts, sent(drawn), target).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("m")))
        at = F.try_element_at("pivots", F.when(F.col("bin") > 0, F.col("bin")))
        hit = stored(hit.withColumn("pivot", at).withColumn("next", F.try_element_at("pivots", F.col("bin") + 1)), "hit")
        done.append(hit.where(~F.col("apart")).select(*target, F.col("pivot").alias("value")))
        narrowed = hit.where("apart").select(*target, (F.col("left") - F.col("before")).alias("left"), "m", F.coalesce("pivot", "low").alias("low"), F.coalesce("next", "high").alias("high"))
        open_ = stored(narrowed, "open")
        if open_.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at"))
    lower, upper = F.col("at")[F.floor("place")], F.col("at")[F.ceil("place")]
    both = joined(places, found, keys)
    between = F.when(F.floor("place") == F.ceil("place"), lower).otherwise((F.ceil("place") - F.col("place")) * lower + (F.col("place") - F.floor("place")) * upper)
    both = both.withColumn("value", between)
    return both.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares))

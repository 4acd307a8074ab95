"""Retrieval metrics from results (query_id, rank, chunk_id) and gold (query_id, chunk_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.quantiles import joined, percentiles
from plinth.sources.shared import stored


def relevance(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results with ``relevant``: 1 on the first occurrence of a gold chunk, else 0."""
    flags = gold.select("query_id", "chunk_id").distinct().withColumn("gold", F.lit(1))
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank")) == 1
    rows = results.join(flags, ["query_id", "chunk_id"], "left")
    return rows.withColumn("relevant", F.when(first & F.col("gold").isNotNull(), 1).otherwise(0)).drop("gold")


def case_metrics(cases: DataFrame, results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """For each case (query_id): gold and relevant counts, first relevant rank, recall, precision at k, reciprocal rank and nDCG."""
    flags = relevance(results.where(F.col("rank") <= k), gold)
    gain = F.sum(F.col("relevant") / F.log2(F.col("rank") + 1.0))
    found = flags.groupBy("query_id").agg(F.sum("relevant").alias("n_relevant"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_rank"), gain.alias("dcg"))
    expected = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    rows = cases.select("query_id").join(expected, "query_id", "left").join(found, "query_id", "left").fillna(0, ["n_gold", "n_relevant", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    has = F.col("n_gold") > 0
    return rows.select(
        "query_id",
        "n_gold",
        "n_relevant",
        "first_rank",
        F.when(has, F.col("n_relevant") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        (F.col("n_relevant") / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(has, F.col("dcg") / F.when(has, ideal)).otherwise(0.0).alias("ndcg"),
    )


def summary(cases: DataFrame, *by: str) -> DataFrame:
    """Averages over cases; hit rate is the share with a relevant result. Recall and nDCG are rounded per case before."""
    return cases.groupBy(*by).agg(
        F.count("*").alias("n_cases"),
        F.avg((F.col("n_relevant") > 0).cast("double")).alias("hit_rate"),
        F.avg(F.round("recall", 4)).alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg(F.round("ndcg", 4)).alias("ndcg"),
    )


def cutoffs(results: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits, mrr, recalled) over all queries with gold, from the ranks of relevant results alone."""
    flags = relevance(results, gold).where("relevant = 1")
    rows = flags.select("query_id", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    each = rows.groupBy("k", "query_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    return each.groupBy("k").agg(F.count("*").alias("hits"), F.sum(1.0 / F.col("first")).alias("reciprocal"), F.sum("n").alias("recalled"))


def path_matches(actual: Column, expected: Column) -> Column:
    """Whether a result's path is an expected one or ends in it after a slash; not the other way round."""
    a, e = (F.regexp_replace(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), "/+$", "") for x in (actual, expected))
    return (a == e) | F.endswith(a, F.concat(F.lit("/"), e))


def source_relevance(results: Column, expected: Column) -> Column:
    """For results in order, an array of structs with source_path, which are relevant to the expected paths: each takes the first
    matching path that no result before it took. An array of 0 and 1."""

    def take(seen: Column, r: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size(expected)), lambda i: ~F.array_contains(seen["used"], i) & path_matches(r["source_path"], F.element_at(expected, i)))
        some = (F.size(expected) > 0) & (F.size(free) > 0)
        used = F.when(some, F.concat(seen["used"], F.slice(free, 1, 1))).otherwise(seen["used"])
        return F.struct(used.alias("used"), F.concat(seen["flags"], F.array(F.when(some, 1).otherwise(0))).alias("flags"))

    none = F.array().cast("array<int>")
    return F.aggregate(results, F.struct(none.alias("used"), none.alias("flags")), take)["flags"]


def case_results(cases: DataFrame, results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """What a run gives for each case (query_id, and expected_paths, an array, where cases can be matched by source).

    results: (query_id, rank, chunk_id, source_path, text); their first k count. A case with gold chunks is relevant by them, another by
    its expected paths, each of which counts once. Rank is that of the first gold chunk, else of the first expected path. A query's
    results, k at most, are folded in one row. Rates are rounded half to even, as they are averaged later.
    """
    expected = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    flags = relevance(results.where(F.col("rank") <= k), gold)
    result = F.struct("rank", "chunk_id", "source_path", F.length("text").alias("n_chars"), "relevant")
    found = flags.groupBy("query_id").agg(F.sort_array(F.collect_list(result)).alias("r"))
    paths = F.coalesce("expected_paths", F.array().cast("array<string>")) if "expected_paths" in cases.columns else F.array().cast("array<string>")
    rows = cases.select("query_id", paths.alias("paths")).join(expected, "query_id", "left").join(found, "query_id", "left")
    rows = rows.withColumns({"r": F.coalesce("r", F.array().cast(found.schema["r"].dataType)), "n_gold": F.coalesce("n_gold", F.lit(0))})
    by_chunk = F.transform("r", lambda x: x["relevant"])
    rows = rows.withColumn("flags", F.when(F.col("n_gold") > 0, by_chunk).otherwise(source_relevance(F.col("r"), F.col("paths"))))
    rows = rows.withColumn("n_expected", F.when(F.col("n_gold") > 0, F.col("n_gold")).otherwise(F.size("paths")))
    ranks = F.filter(F.transform("flags", lambda f, i: F.when(f == 1, i + 1)), lambda x: x.isNotNull())
    chunk_rank = F.array_min(F.filter(F.transform("r", lambda x, i: F.when(x["relevant"] == 1, i + 1)), lambda x: x.isNotNull()))
    hit = F.transform("r", lambda x, i: F.when(F.exists("paths", lambda p: path_matches(x["source_path"], p)), i + 1))
    rows = rows.withColumns({"relevant_ranks": ranks, "chunk_rank": chunk_rank, "source_rank": F.array_min(F.filter(hit, lambda x: x.isNotNull()))})
    rank = F.coalesce("chunk_rank", "source_rank")
    chars = F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["n_chars"])
    relevant_chars = F.aggregate(F.zip_with("r", "flags", lambda x, f: F.when(f == 1, x["n_chars"]).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    dcg = F.aggregate("relevant_ranks", F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_expected", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    rows = rows.withColumns({"rank": rank, "chars": chars, "relevant_chars": relevant_chars, "dcg": dcg})
    return rows.select(
        "query_id",
        "rank",
        F.when(F.col("chunk_rank").isNotNull(), "chunk_id").when(F.col("source_rank").isNotNull(), "source_path").otherwise("none").alias("matched_by"),
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.size("r").alias("n_retrieved"),
        F.col("n_expected").cast("long").alias("n_expected"),
        F.size("relevant_ranks").alias("n_relevant"),
        "relevant_ranks",
        F.bround(F.when(F.col("n_gold") > 0, F.size("relevant_ranks") / F.col("n_gold")).otherwise(0.0), 4).alias("recall"),
        F.bround(F.size("relevant_ranks") / F.lit(float(k)), 4).alias("precision"),
        F.bround(F.when(F.col("n_expected") > 0, F.col("dcg") / F.when(F.col("n_expected") > 0, ideal)).otherwise(0.0), 4).alias("ndcg"),
        F.bround(F.when(F.col("chars") > 0, F.col("relevant_chars") / F.col("chars")).otherwise(0.0), 4).alias("density"),
        F.col("chars").alias("context_chars"),
        F.ceil(F.col("chars") / F.lit(4.0)).cast("long").alias("context_tokens"),
    )


def all_metrics(cases: DataFrame, k: int = 5) -> DataFrame:
    """One row with the metrics of a run over the rows of case_results, which may also have evidence_coverage, mapping_coverage,
    duplicate_ratio and latency_ms; nulls of the first two are left out, and the share of cases that have them is told."""

    def column(name: str) -> Column:
        return F.col(name).cast("double") if name in cases.columns else F.lit(None).cast("double")

    def mean(c: Column) -> Column:
        return F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 4)

    def precise(n: int) -> Column:
        return mean(F.size(F.filter("relevant_ranks", lambda r: r <= n)) / F.lit(float(n)))

    def hit(n: int) -> Column:
        return mean(F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double"))

    def have(name: str) -> Column:
        return mean(column(name).isNotNull().cast("double"))

    latency = column("latency_ms")
    cases = stored(cases, "cases")
    found = {
        **{f"hit_{n}": hit(n) for n in (1, 3, 5)}, "hit_k": hit(k), **{f"precision_{n}": precise(n) for n in (1, 3, 5)}, "precision_k": precise(k),
        "mrr": mean(F.col("reciprocal_rank")), "recall_k": mean(F.col("recall")), "ndcg_k": mean(F.col("ndcg")),
        "evidence_coverage_k": mean(column("evidence_coverage")), "evidence_coverage_case_rate": have("evidence_coverage"),
        "mapping_coverage": mean(column("mapping_coverage")), "mapping_coverage_case_rate": have("mapping_coverage"),
        "context_density": mean(F.col("density")), "duplicate_ratio": mean(F.coalesce(column("duplicate_ratio"), F.lit(0.0))),
        "latency_mean": mean(latency),
        "retrieved": mean(F.col("n_retrieved").cast("double")), "context_chars": mean(F.col("context_chars").cast("double")), "context_tokens": mean(F.col("context_tokens").cast("double")),
    }
    ranks = percentiles(cases.select(latency.alias("v")), "v", {"latency_p50": 0.5, "latency_p95": 0.95})
    ranks = ranks.select(*(F.bround(n, 4).alias(n) for n in ("latency_p50", "latency_p95")))
    return cases.agg(*(c.alias(n) for n, c in found.items())).join(F.broadcast(ranks))  # a row each


def stage_latencies(stages: DataFrame) -> DataFrame:
    """For each stage of traces (name, latency_ms) that has a name: samples, mean and percentiles of its latency, rounded half to even."""
    rows = stages.where((F.coalesce("name", F.lit("")) != "") & F.col("latency_ms").isNotNull())
    found = latencies(rows, "latency_ms", "name")
    return found.select("name", F.col("n").alias("samples"), *(F.bround(c, 4).alias(c) for c in ("mean", "p50", "p95")))


def compact_results(results: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, top): each query's results in order as JSON, with a short text."""
    row = F.struct("rank", "chunk_id", "source_path", F.substring(F.regexp_replace("text", r"\s+", " "), 1, most).alias("preview"))
    return results.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("top"))


def failures(cases: DataFrame, results: DataFrame, gold: DataFrame, spans: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Why a case fails at k; ``passed`` where it doesn't.

    cases: (query_id, and expected_paths where there are any); results: (query_id, rank, chunk_id, source_path); gold: (query_id,
    chunk_id); spans: (query_id, span_id, source_path, mapped), the evidence that the gold comes from, if it does. In this order:
    no_result; unmapped_evidence, where a span maps to no chunk and there is no gold; missed_source, where no result is of the expected
    paths, or else of the spans' sources; wrong_section, where gold from spans is missed, but a result is of a span's source; low_rank,
    where gold is missed otherwise; unknown.
    """
    top = results.where(F.col("rank") <= k)
    paths = F.coalesce("expected_paths", F.array().cast("array<string>")) if "expected_paths" in cases.columns else F.array().cast("array<string>")
    rows = cases.select("query_id", paths.alias("paths"))
    want = gold.select("query_id", "chunk_id").distinct()
    by = [want.groupBy("query_id").agg(F.count("*").alias("n_gold")), top.groupBy("query_id").agg(F.collect_set("source_path").alias("sources"))]
    by.append(top.join(want, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_hits")))
    if spans is not None:
        near = spans.select("query_id", "source_path").distinct().join(top.select("query_id", F.col("source_path").alias("actual")).distinct(), "query_id")
        near = near.groupBy("query_id").agg(F.count_if(path_matches(F.col("actual"), F.col("source_path"))).alias("n_near"))
        by += [spans.groupBy("query_id").agg(F.count("*").alias("n_spans"), F.count_if(~F.col("mapped")).alias("n_unmapped")), near]
    for part in by:
        rows = rows.join(part, "query_id", "left")
    absent = [c for c in ("n_spans", "n_unmapped", "n_near") if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(0) for c in absent}).fillna(0, ["n_gold", "n_hits", "n_spans", "n_unmapped", "n_near"])
    of_source = F.exists("paths", lambda p: F.exists("sources", lambda a: path_matches(a, p)))
    missed = F.when(F.size("paths") > 0, ~of_source).otherwise((F.col("n_spans") > 0) & (F.col("n_near") == 0))
    kind = (
        F.when((F.col("n_hits") > 0) | of_source, "passed")
        .when(F.col("sources").isNull(), "no_result")
        .when((F.col("n_spans") > 0) & (F.col("n_unmapped") > 0) & (F.col("n_gold") == 0), "unmapped_evidence")
        .when(missed, "missed_source")
        .when((F.col("n_gold") > 0) & (F.col("n_spans") > F.col("n_unmapped")) & (F.col("n_near") > 0), "wrong_section")
        .when(F.col("n_gold") > 0, "low_rank")
        .otherwise("unknown")
    )
    return rows.select("query_id", kind.alias("failure"))


def duplicate_context(results: DataFrame, width: int = 20) -> DataFrame:
    """(query_id, duplicate_ratio): the share of a query's character shingles, a set for each result, that repeat other results'."""
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.length("flat") - width + 1, F.lit(1)))
    rows = results.withColumn("flat", flat).select("query_id", "rank", "flat", F.explode(starts).alias("i"))
    shingles = rows.select("query_id", "rank", F.xxhash64(F.substring("flat", F.col("i"), F.lit(width))).alias("s")).distinct()
    each = shingles.groupBy("query_id", "s").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.sum("n").alias("all"), F.count("*").alias("union"))
    return each.select("query_id", ((F.col("all") - F.col("union")) / F.col("all")).alias("duplicate_ratio"))


def latencies(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, median, 95th percentile (between neighbours in proportion) and maximum; no task holds a group."""
    v = F.col(value)
    kept = stored(rows.select(*by, v), "latencies")
    sums = kept.groupBy(*by).agg(F.avg(v).alias("mean"), F.max(v).alias("maximum"))
    found = percentiles(kept, value, {"p50": 0.5, "p95": 0.95}, *by)
    return joined(found, sums, list(by)).select(*by, "n", "mean", "p50", "p95", "maximum")


def transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases (query_id, hit) of two runs, counted as retained, lost, gained or missed."""
    both = baseline.select("query_id", F.col("hit").alias("a")).join(candidate.select("query_id", F.col("hit").alias("b")), "query_id")
    kind = F.when(F.col("a") & F.col("b"), "retained").when(F.col("a"), "lost").when(F.col("b"), "gained").otherwise("missed")
    return both.groupBy(kind.alias("transition")).agg(F.count("*").alias("n"))


def screen_transitions(baseline: DataFrame, candidate: DataFrame, canaries: DataFrame | None = None) -> DataFrame:
    """Per case (query_id) how a candidate run (query_id, hit) compares with all trials of a baseline (query_id, trial, hit).

    A case that hit in some trials only, or is a canary (query_id), is at the boundary; others are retained, lost, gained or unchanged_miss.
    """
    trials = baseline.groupBy("query_id").agg(F.count_if("hit").alias("n_hits"), F.count("*").alias("n_trials"))
    rows = trials.join(candidate.select("query_id", "hit"), "query_id")
    rows = rows.withColumn("canary", F.lit(False)) if canaries is None else rows.join(canaries.select("query_id", F.lit(True).alias("canary")).distinct(), "query_id", "left")
    mixed = F.coalesce("canary", F.lit(False)) | ((F.col("n_hits") > 0) & (F.col("n_hits") < F.col("n_trials")))
    always = F.when(F.col("hit"), "retained").otherwise("lost")
    kind = F.when(mixed, "boundary").when(F.col("n_hits") > 0, always).otherwise(F.when(F.col("hit"), "gained").otherwise("unchanged_miss"))
    return rows.select("query_id", "n_hits", "n_trials", "hit", kind.alias("transition"))


def spread(metrics: DataFrame, *by: str) -> DataFrame:
    """Least, greatest and spread of ``value`` over runs."""
    return metrics.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("greatest"), (F.max("value") - F.min("value")).alias("spread"))

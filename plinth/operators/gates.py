"""Comparing runs: cold and warm trials, changes between screens, gates, consensus and matrices of trials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.numbering import numbered
from plinth.operators.quantiles import joined, percentiles
from plinth.sources.shared import sent, stored


def cold_and_warm(samples: DataFrame, *by: str) -> DataFrame:
    """Latencies (trial, seq, latency_ms): the first of each trial, by a seq that tells its samples apart, is cold; mean and percentiles
    of the others. A trial's first is found by an aggregation, so no task holds a trial."""
    keys = list(by)
    kept = stored(samples.select(*keys, "trial", "seq", "latency_ms"), "samples")
    first = stored(kept.groupBy(*keys, "trial").agg(F.min("seq").alias("first"), F.min_by("latency_ms", "seq").alias("cold")), "first")
    warm = stored(joined(kept, sent(first), [*keys, "trial"]).where(F.col("seq") != F.col("first")).select(*keys, "latency_ms"), "warm")
    cold = first.groupBy(*keys).agg(F.avg("cold").alias("cold_ms"))
    mean = warm.groupBy(*keys).agg(F.avg("latency_ms").alias("warm_ms"))
    ranks = percentiles(warm, "latency_ms", {"warm_p50": 0.5, "warm_p95": 0.95}, *keys)
    rows = joined(joined(cold, mean, keys, "left"), ranks, keys, "left")
    return rows.select(*keys, "cold_ms", "warm_ms", "warm_p50", "warm_p95")


def stable_rankings(results: DataFrame) -> DataFrame:
    """For each query (trial, query_id, rank, chunk_id) the number of different rankings over the trials; 1 is stable."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), "\n")
    each = results.groupBy("query_id", "trial").agg(F.sha2(ids, 256).alias("fingerprint"))
    return each.groupBy("query_id").agg(F.count_distinct("fingerprint").alias("n_rankings"))


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """For one row of metrics a row for each gate: its name, value, limit and whether it passed; limits: name -> ('>=' or '<=', number)."""
    parts = []
    for name, (side, limit) in sorted(limits.items()):
        value: Column = F.col(name).cast("double")
        ok = value >= limit if side == ">=" else value <= limit
        parts.append(F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(limit).alias("limit"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return metrics.select(F.explode(F.array(*parts)).alias("g")).select("g.*")


def consensus(flags: DataFrame, least: int = 2) -> DataFrame:
    """Cases (query_id, trial, hit) that hit in at least ``least`` trials."""
    return flags.groupBy("query_id").agg(F.count_if("hit").alias("n_hits"), F.count("*").alias("n_trials")).withColumn("agreed", F.col("n_hits") >= least)


def open_trials(modes: DataFrame, limits: list[int], repetitions: int, finished: DataFrame) -> DataFrame:
    """The trials (mode, k, repetition) of a matrix, every mode (a row each) at every limit so often, that ``finished`` doesn't hold yet."""
    each = modes.select("mode", F.explode(F.array(*map(F.lit, limits))).alias("k"))
    grid = each.select("mode", "k", F.explode(F.array(*map(F.lit, range(repetitions)))).alias("repetition"))
    return grid.join(finished, ["mode", "k", "repetition"], "left_anti")


def checks(row: DataFrame, **conditions: Column) -> DataFrame:
    """Named conditions over one row, and whether all hold; null counts as failed."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    every = None
    for c in flags.values():
        every = c if every is None else every & c
    return row.select(*(c.alias(n) for n, c in flags.items()), every.alias("all_passed"))


def farthest(points: DataFrame, count: int, *by: str) -> DataFrame:
    """(by, place, id) of ``count`` points (id, position) of each group, spread out: the first, then always the one farthest from all
    chosen; of ties the least id. Ids tell a group's points apart.

    All groups go together, a choice being one aggregation that Spark combines before it shuffles; only the few chosen points are joined
    back, so no task holds a group and nothing passes the driver.
    """
    keys = list(by)
    kept = stored(points.select(*keys, "id", F.col("position").cast("double").alias("position")), "points")
    point = F.struct("id", "position")
    chosen = kept.groupBy(*keys).agg(F.array(F.min_by(point, "id")).alias("chosen")).where(F.col("chosen")[0].isNotNull())
    for _ in range(1, count):
        chosen = stored(chosen, "chosen")
        near = F.array_min(F.transform("chosen", lambda c: F.abs(F.col("position") - c["position"])))
        open_ = joined(kept, sent(chosen), keys).where(~F.exists("chosen", lambda c: c["id"] == F.col("id")))
        best = open_.groupBy(*keys).agg(F.max_by(point, F.struct(near, -F.col("id"))).alias("next"))
        grown = F.when(F.col("next").isNotNull(), F.concat("chosen", F.array("next"))).otherwise(F.col("chosen"))
        chosen = joined(chosen, best, keys, "left").select(*keys, grown.alias("chosen"))
    rows = chosen.select(*keys, F.posexplode("chosen").alias("place", "c")).where(F.col("place") < count)
    return rows.select(*keys, "place", F.col("c.id").alias("id"))


def review(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases (query_id, query, answer) after a review (query_id, decision, original_hash, new_query, new_answer).

    Every case needs one decision, approved or corrected, whose hash is that of the case as it is (``case_hash``); else it is an error
    when it is read. Corrected cases take what is new of query and answer, and tell that they were changed.
    """
    n = decisions.groupBy("query_id").agg(F.count("*").alias("n"), F.first("decision").alias("decision"), F.first("original_hash").alias("hash"), F.first("new_query").alias("nq"), F.first("new_answer").alias("na"))
    rows = cases.join(n, "query_id", "left")
    wrong = (
        F.when(F.coalesce("n", F.lit(0)) != 1, F.lit("a case needs one decision"))
        .when(~F.coalesce(F.col("decision").isin("approved", "corrected"), F.lit(False)), F.lit("unknown decision"))
        .when(~F.coalesce(F.col("hash") == case_hash(F.col("query"), F.col("answer")), F.lit(False)), F.lit("a case changed since its review"))
    )
    changed = F.col("decision") == "corrected"
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(changed)
    return rows.select("query_id", *(F.when(changed, F.coalesce(new, old)).otherwise(F.col(old)).alias(old) for old, new in (("query", "nq"), ("answer", "na"))), checked.alias("changed"))


def case_hash(query: Column, answer: Column) -> Column:
    return F.sha2(F.concat_ws("\n", query, answer), 256)


def violations(rows: DataFrame, key: str, most: int = 20, **conditions: Column) -> DataFrame:
    """(condition, n, examples): how many rows break each condition, and the first ``most`` of their keys, joined by commas; null breaks it."""
    broken = F.array(*(F.struct(F.lit(n).alias("condition"), (~F.coalesce(c, F.lit(False))).alias("broken")) for n, c in conditions.items()))
    each = rows.select(F.col(key).alias("key"), F.explode(broken).alias("b")).select("key", "b.*")
    place = F.row_number().over(Window.partitionBy("condition").orderBy("key"))
    counts = each.groupBy("condition").agg(F.count_if("broken").alias("n"))
    first = each.where("broken").withColumn("place", place).where(F.col("place") <= most)
    shown = first.groupBy("condition").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"].cast("string")), ",").alias("examples"))
    return counts.join(shown, "condition", "left").select("condition", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def mode_gates(rows: DataFrame, counts: dict[str, tuple[Column, int]], sums: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """(gate, value, limit, passed, cases) over cases of several modes (mode, query_id, ...).

    counts: how many cases may break a condition at most, by the column that says so; their names, mode:query_id, are listed, the first
    twenty. sums: an aggregate of all rows, and whether it must be ``>=`` or ``<=`` a number. Null breaks a condition, and fails a sum.
    """
    kept = stored(rows, "cases")
    keyed = kept.withColumn("__case", F.concat_ws(":", "mode", F.col("query_id").cast("string")))
    broken = violations(keyed, "__case", **{name: ~c for name, (c, _) in counts.items()})
    most = F.create_map(*(F.lit(x) for name, (_, n) in counts.items() for x in (name, float(n))))
    limit = F.element_at(most, F.col("condition"))
    counted = broken.select(F.col("condition").alias("gate"), F.col("n").cast("double").alias("value"), limit.alias("limit"), (F.col("n") <= limit).alias("passed"), F.col("examples").alias("cases"))
    if not sums:
        return counted
    row = kept.agg(*(c.cast("double").alias(name) for name, (c, _, _) in sums.items()))
    return counted.unionByName(gates(row, {name: (side, n) for name, (_, side, n) in sums.items()}).withColumn("cases", F.lit("")))


def _of(mode: str, value: Column) -> Column:
    return F.when(F.col("mode") == mode, value)


def _hits(mode: str, flag: str) -> Column:
    return F.avg(_of(mode, F.col(flag).cast("double")))


def replay_gates(rows: DataFrame, first: str, second: str, budget: int, losses: tuple[int, int] = (0, 0), ratio: float = 1.0, least: int = 1) -> DataFrame:
    """The six gates of a replay within a budget, over the cases of two modes as ``selection.replay`` gives them: hits that either mode
    loses, the second's context against all its results, and contexts that are empty, over the budget, or no prefix of the ranking."""
    lost = F.col("parent_hit") & ~F.col("hit")
    context = F.avg(_of(second, F.col("chars_kept"))) / F.avg(_of(second, F.col("chars_all")))
    counts = {f"{mode}_hits_retained": ((F.col("mode") == mode) & lost, n) for mode, n in zip((first, second), losses, strict=True)}
    counts |= {"contexts_nonempty": (F.col("n_kept") < least, 0), "contexts_within_budget": (F.col("chars_kept") > 4 * budget, 0), "ranked_prefix_kept": (F.col("n_kept") != F.col("last_kept"), 0)}
    return mode_gates(rows, counts, {f"{second}_context_tokens": (context, "<=", ratio)})


def direction_gates(rows: DataFrame, first: str, second: str, gains: tuple[float, float] = (0.0, 0.0), losses: tuple[int, int] = (0, 0), ratio: float = 1.0, missed: int = 0) -> DataFrame:
    """The seven gates that confirm a direction, over cases (mode, query_id, parent_hit, candidate_hit, hit, parent_missed, missed,
    chars_kept, parent_chars, n_kept, last_kept, within): how much each mode's hit rate changes at least, sources newly missed, hits of
    the candidate that its selection loses in either mode, the second's context against its parent's, and broken invariants."""
    lost = F.col("candidate_hit") & ~F.col("hit")
    counts = {f"{mode}_context_hits_retained": ((F.col("mode") == mode) & lost, n) for mode, n in zip((first, second), losses, strict=True)}
    counts |= {"no_new_missed_source": (F.col("missed") & ~F.col("parent_missed"), missed), "invariants": (~F.col("within") | (F.col("n_kept") != F.col("last_kept")), 0)}
    sums = {f"{mode}_hit_direction": (_hits(mode, "candidate_hit") - _hits(mode, "parent_hit"), ">=", n) for mode, n in zip((first, second), gains, strict=True)}
    context = F.avg(_of(second, F.col("chars_kept"))) / F.avg(_of(second, F.col("parent_chars")))
    return mode_gates(rows, counts, sums | {f"{second}_context_tokens": (context, "<=", ratio)})


#: What a selection of fragments may look at.
SELECTOR_INPUTS = ("query_tokens", "window_tokens", "signal_tokens")


def fragment_gates(
    rows: DataFrame, losses: dict[str, int], context_of: str, inputs: tuple[str, ...] = SELECTOR_INPUTS, unreachable: int = 0, ratio: float = 1.0, coverage: tuple[float, float, float] | None = None
) -> DataFrame:
    """The gates of fragment packing, over cases (mode, query_id, parent_hit, scorable, oracle_hit, hit, n_results, n_fragments, n_lost,
    chars, budget, n_unmapped, parent_chars): evidence of the parent's hits that the best windows can't reach or that can't be scored,
    hits that the selection loses in each mode, results without a fragment, fragments that stray from their chunk, contexts over their
    budget, unmapped fragments, one mode's context against its parent's, and whether the selector saw its own inputs alone; nine for two modes.

    With ``coverage``, the gates of a confirmation besides: least mean share of the reachable evidence that is held (``held``), least share
    of a case, and least mean share of what the best windows hold (``efficiency``), each a column of the rows; and that each mode has
    parent's hits at all.
    """
    hit = F.col("parent_hit")
    counts = {f"{mode}_fragment_hits_retained": ((F.col("mode") == mode) & hit & F.col("scorable") & ~F.col("hit"), n) for mode, n in losses.items()}
    counts |= {
        "oracle_evidence_reachable": (hit & (~F.col("scorable") | ~F.col("oracle_hit")), unreachable), "all_candidates_represented": (F.col("n_fragments") != F.col("n_results"), 0),
        "fragments_traceable": (F.col("n_lost") > 0, 0), "contexts_within_budget": (F.col("chars") > F.col("budget"), 0), "fragments_mapped": (F.col("n_unmapped") > 0, 0),
    }
    own = float(tuple(inputs) == SELECTOR_INPUTS)
    sums = {f"{context_of}_context_tokens": (F.avg(_of(context_of, F.col("chars"))) / F.avg(_of(context_of, F.col("parent_chars"))), "<=", ratio), "selector_isolated": (F.max(F.lit(own)), ">=", 1.0)}
    if coverage:
        mean, least, efficiency = coverage
        counts |= {"case_coverage": (F.col("scorable") & (F.coalesce("held", F.lit(0.0)) < least), 0)}
        for mode in losses:
            sums |= {f"{mode}_coverage": (F.avg(_of(mode, F.col("held"))), ">=", mean), f"{mode}_efficiency": (F.avg(_of(mode, F.col("efficiency"))), ">=", efficiency), f"{mode}_parent_hits": (F.sum(_of(mode, hit.cast("double"))), ">=", 1.0)}
    return mode_gates(rows, counts, sums)


def generated_cases(spans: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases made of evidence spans (span_id, text), and the spans that gave none, with the reason.

    ``generate`` answers prompts (span_id, prompt) with (span_id, answer); an answer must be a JSON object with a question and an answer,
    both text, and nothing else. Cases are numbered in the order of their spans.
    """
    ask = "Write one question that only this passage answers, as a JSON object with question and answer.\n\n"
    prompts = spans.select("span_id", F.concat(F.lit(ask), "text").alias("prompt"))
    rows = spans.select("span_id").join(generate(prompts), "span_id", "left")
    keys = F.array_sort(F.json_object_keys("answer"))
    parsed = F.from_json("answer", "question string, answer string")
    rows = rows.withColumn("p", F.when(keys == F.array(F.lit("answer"), F.lit("question")), parsed))
    reason = F.when(F.col("answer").isNull(), "no answer").when(F.col("p").isNull(), "not the JSON that was asked for").when((F.coalesce(F.trim("p.question"), F.lit("")) == "") | (F.coalesce(F.trim("p.answer"), F.lit("")) == ""), "an empty field")
    rows = stored(rows.withColumn("reason", reason), "answers")
    good = numbered(rows.where("reason is null").select("span_id", "p.question", F.col("p.answer").alias("answer")), "span_id")
    cases = good.select(F.format_string("synthetic-span-%06d", F.col("number") + 1).alias("case_id"), "span_id", F.trim("question").alias("query"), F.trim("answer").alias("answer"))
    return cases, rows.where("reason is not null").select("span_id", "reason")


def screen_gates(cases: DataFrame, gained: int = 1, gained_wide: int = 1, longest: float = 1.1) -> DataFrame:
    """Whether a candidate run may replace a baseline: (gate, value, passed).

    cases: (mode, k, query_id, role, baseline_hits, n_trials, baseline_missed_source, candidate_hit, candidate_failure, baseline_tokens,
    candidate_tokens) at the narrow and the wide k; roles are stable or challenge. No stable case may be lost at the narrow k in the
    semantic mode; no case may newly miss its source; enough challenges that never hit must be gained at either k; in the hybrid mode
    hits, counted for the baseline where most trials hit, must not fall, and context must not grow beyond ``longest`` times.
    """
    narrow = F.col("k") == cases.agg(F.min("k")).first()[0]
    semantic, hybrid, challenge = F.col("mode") == "semantic", F.col("mode") == "hybrid", F.col("role") == "challenge"
    fresh = semantic & challenge & (F.col("baseline_hits") == 0) & F.col("candidate_hit")
    row = cases.agg(
        F.count_if(semantic & narrow & (F.col("role") == "stable") & ~F.col("candidate_hit")).alias("stable_losses"),
        F.count_if((F.col("candidate_failure") == "missed_source") & ~F.col("baseline_missed_source")).alias("new_missed_sources"),
        F.count_if(fresh & narrow).alias("gains"),
        F.count_if(fresh & ~narrow).alias("wide_gains"),
        F.sum(F.when(hybrid & narrow, F.col("candidate_hit").cast("long") - (2 * F.col("baseline_hits") > F.col("n_trials")).cast("long")).otherwise(0)).alias("hybrid_change"),
        (F.sum(F.when(hybrid & narrow, F.col("candidate_tokens"))) / F.sum(F.when(hybrid & narrow, F.col("baseline_tokens")))).alias("token_ratio"),
    )
    enough = (F.col("gains") >= gained) | (F.col("wide_gains") >= gained_wide)
    found = (
        ("stable_losses", F.col("stable_losses") == 0), ("new_missed_sources", F.col("new_missed_sources") == 0), ("gains", enough), ("wide_gains", enough),
        ("hybrid_change", F.col("hybrid_change") >= 0), ("token_ratio", F.coalesce(F.col("token_ratio") <= longest, F.lit(True))),
    )
    parts = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), c.alias("passed")) for n, c in found))
    return row.select(F.explode(parts).alias("g")).select("g.*")

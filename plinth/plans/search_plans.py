"""Registered queries over search, selection, evaluation and history, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions import unicode as U
from plinth.operators import chunking, evaluate, evidence, gates, history, retrieval, selection
from plinth.plans.engine import Engine
from plinth.plans.text_plans import CHUNKS, DOCS, chunks_of
from plinth.sources import files, providers
from plinth.sources.shared import new_folder, sent, stored
from plinth.sources.tables import documents, table, vectors

LIMIT, K = 10, 5


def cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def shown(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", F.round("score", 6))


def counted_of(spark: SparkSession, sf_dir: str) -> retrieval.Counted:
    """The pass over the chunks that searches of either mode share."""
    return retrieval.count_for(chunks_of(spark, sf_dir), cases_of(spark, sf_dir))


def results_of(spark: SparkSession, sf_dir: str, mode: str, limit: int = LIMIT, counted: retrieval.Counted | None = None) -> DataFrame:
    search = {"lexical": retrieval.lexical_search, "bm25": retrieval.bm25_search}[mode]
    return search(chunks_of(spark, sf_dir), cases_of(spark, sf_dir), limit, counted=counted)


def with_chunks(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Results with their chunks' columns. Results are few, queries times limit, so they are written and counted: only the documents that
    they name are cut into chunks, and these meet the results where they are, instead of being shuffled."""
    ranked = stored(ranked, "ranked")
    paths = ranked.select(F.regexp_replace("chunk_id", "::chunk-[0-9]+$", "").alias("source_path")).distinct()
    chunks = chunking.sliding_chunks(documents(spark, sf_dir).join(sent(paths), "source_path", "left_semi"))
    return chunks.join(sent(ranked), "chunk_id")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Few rows that much work is done on, dealt over as many tasks as shuffles have."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a passage stands in a document, as an evidence span."""
    docs = documents(spark, sf_dir)
    found = evidence.find_passages(docs, cases_of(spark, sf_dir)).join(docs.select("document_id", "source_path"), "document_id")
    later = F.when(F.col("place") > 0, F.col("start_char").cast("string"))
    name = F.concat_ws("-", F.col("query_id").cast("string"), F.col("document_id").cast("string"), later)
    return found.select(name.alias("span_id"), "query_id", "document_id", "source_path", "start_char", "end_char")


def gold_of(spark: SparkSession, sf_dir: str, spans: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id): chunks that hold enough of a span of the query. Spans are sought once and stored, unless they are given."""
    spans = stored(spans_of(spark, sf_dir), "spans") if spans is None else spans
    mapped = evidence.map_spans(spans, chunks_of(spark, sf_dir)) if mapped is None else mapped
    return mapped.join(spans.select("span_id", "query_id"), "span_id").select("query_id", "chunk_id").distinct()


def metrics_of(spark: SparkSession, sf_dir: str, mode: str, k: int, gold: DataFrame | None = None, counted: retrieval.Counted | None = None) -> DataFrame:
    gold = stored(gold_of(spark, sf_dir), "gold") if gold is None else gold
    return evaluate.case_metrics(cases_of(spark, sf_dir), stored(results_of(spark, sf_dir, mode, counted=counted), "results"), gold, k)


def corpus_stats(spark, sf_dir):
    return retrieval.corpus_statistics(chunks_of(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


def lexical_search(spark, sf_dir):
    return shown(results_of(spark, sf_dir, "lexical"))


def bm25_search(spark, sf_dir):
    return shown(results_of(spark, sf_dir, "bm25"))


def cosine_pairs(spark, sf_dir):
    """Every vector and its successor."""
    rows = vectors(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(retrieval.cosine("embedding", "next"), 6).alias("cosine"))


def semantic_search(spark, sf_dir):
    """Every twentieth vector against all."""
    rows = vectors(spark, sf_dir)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return shown(retrieval.semantic_search(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, LIMIT))


def hybrid_rrf(spark, sf_dir):
    """Passages against whole documents, whose vectors have their ids; a passage's vector is that of its id."""
    chunks = documents(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), "text")
    index = vectors(spark, sf_dir)
    cases = cases_of(spark, sf_dir)
    queries = index.join(cases.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.hybrid_search(chunks, index.select(F.col("vec_id").alias("chunk_id"), "embedding"), cases, queries, LIMIT)
    return found.withColumn("score", F.round("score", 9))


def dedup_candidates(spark, sf_dir):
    """Lexical results followed by BM25's, each chunk once."""
    counted = counted_of(spark, sf_dir)
    both = results_of(spark, sf_dir, "lexical", counted=counted).union(results_of(spark, sf_dir, "bm25", counted=counted).withColumn("rank", F.col("rank") + LIMIT))
    return retrieval.deduplicate(both).select("query_id", "rank", "chunk_id")


def metadata_redact(spark, sf_dir):
    """Keys that stay of metadata whose names depend on the document."""
    docs = documents(spark, sf_dir)
    k = F.col("document_id") % 4
    names = F.array(F.concat(F.lit("page_"), "lang"), F.when(k == 0, "text_context").otherwise("section"), F.when(k == 1, "api_key").otherwise("title"), F.when(k == 2, "Authorization").otherwise("level"), F.concat("lang", F.lit("_vector")))
    kept = docs.select("document_id", retrieval.redact_metadata(F.map_from_arrays(names, F.transform(names, lambda n: F.upper(n)))).alias("m"))
    return kept.select("document_id", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("keys"), F.array_join(F.sort_array(F.map_values("m")), ",").alias("held"))


def retrieval_stages(spark, sf_dir):
    """Rows that go into and come out of each stage of a BM25 run with a budget of 256 tokens."""
    return Engine(chunks_of(spark, sf_dir)).stages(cases_of(spark, sf_dir), "bm25", LIMIT, 256).drop("latency_ms")


def ranking_rehydrate(spark, sf_dir):
    rows = retrieval.rehydrate(results_of(spark, sf_dir, "bm25"), chunks_of(spark, sf_dir))
    return rows.select("query_id", "rank", "chunk_id", "document_id", "start_char", "end_char", F.sha2("text", 256).alias("text_sha256"))


def token_budget_prefix(spark, sf_dir):
    kept = selection.budget_prefix(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")), 1024)
    return kept.select("query_id", "rank", "chunk_id", "running_chars")


def context_pack(spark, sf_dir):
    packed = selection.context_pack(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")))
    return packed.select("query_id", "rank", "chunk_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def prompt_render(spark, sf_dir):
    packed = selection.context_pack(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")))
    rows = selection.prompt(packed.join(cases_of(spark, sf_dir), "query_id"), question=True)
    return rows.select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("n_chars"))


def budget_frontier(spark, sf_dir):
    ranked = with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25"))
    return selection.budget_frontier(ranked, gold_of(spark, sf_dir), [256, 512, 768, 1024, 1400, 2048])


def fragments_of(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """BM25 results, found again unless they are given with their chunks, with the header of their fragment and the characters dealt to it."""
    found = with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")) if found is None else found
    rows = found.join(cases_of(spark, sf_dir), "query_id")
    page = (F.floor(F.col("start_char") / 3000) + 1).cast("string")
    header = selection.fragment_header(F.col("rank"), F.col("document_id").cast("string"), page)
    kept = stored(rows.select("query_id", "rank", "chunk_id", "query", "text", header.alias("header")), "ranked")
    return spread(selection.allocate(kept), "query_id", "rank")


def fragment_allocation(spark, sf_dir):
    return fragments_of(spark, sf_dir).select("query_id", "rank", F.length("text").alias("n_chars"), "allocation")


def fragment_windows(spark, sf_dir):
    rows = selection.fragment_windows(fragments_of(spark, sf_dir).select("query_id", "chunk_id", "text", "allocation"))
    return rows.select("query_id", "chunk_id", "window_start", "window_end", F.sha2("window_text", 256).alias("text_sha256"))


def best_fragments(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """The window of each BM25 result that says most about its query; what a chunk begins with is its signal."""
    rows = fragments_of(spark, sf_dir, found).withColumns({"query_tokens": U.folded_tokens("query"), "signal_tokens": U.folded_tokens(F.substring("text", 1, 60))})
    cut = selection.fragment_windows(stored(rows, "fragments")).withColumn("window_tokens", U.folded_tokens("window_text"))
    return selection.best_windows(selection.fragment_scores(cut), "query_id", "rank", "chunk_id", "header")


def fragment_scores(spark, sf_dir):
    return best_fragments(spark, sf_dir).select("query_id", "chunk_id", "window_start", "window_end", "n_unique", "n_occurrences", "n_bigrams", "n_signals")


def fragment_contexts(spark, sf_dir):
    """The rendered fragments of each query, none of which strays from its chunk."""
    best = stored(best_fragments(spark, sf_dir), "fragments")
    lost = selection.untraceable(best, chunks_of(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_lost"))
    rows = selection.render_fragments(best).join(lost, "query_id", "left")
    return rows.select("query_id", F.sha2("context", 256).alias("context_sha256"), F.length("context").alias("n_chars"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def evidence_windows(spark, sf_dir):
    """The window of each BM25 result that holds most of the passage itself, by its token trigrams."""
    rows = stored(fragments_of(spark, sf_dir).withColumn("evidence_tokens", U.folded_tokens("query")), "fragments")
    cut = selection.fragment_windows(rows).withColumn("window_tokens", U.folded_tokens("window_text"))
    best = selection.best_windows(selection.evidence_scores(cut), "query_id", "chunk_id")
    return best.select("query_id", "chunk_id", "window_start", "window_end", F.col("n_unique").alias("n_trigrams"), "n_occurrences", "n_bigrams")


def fragment_evidence(spark, sf_dir):
    return evidence_of_fragments(spark, sf_dir, stored(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")), "found"))


def evidence_of_fragments(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """How many of a passage's token trigrams its results hold, the windows chosen for the passage itself, and those chosen for the query."""

    def grams(column: str) -> Column:
        return T.ngrams(U.folded_tokens(column), 3).alias("grams")

    rows = stored(fragments_of(spark, sf_dir, found).withColumn("query_tokens", U.folded_tokens("query")), "fragments")
    cut = stored(selection.fragment_windows(rows).withColumn("window_tokens", U.folded_tokens("window_text")), "windows")
    chosen = selection.best_windows(selection.fragment_scores(cut), "query_id", "chunk_id")
    oracle = selection.best_windows(selection.evidence_scores(cut.withColumn("evidence_tokens", F.col("query_tokens"))), "query_id", "chunk_id")
    held = selection.evidence_held(
        cases_of(spark, sf_dir).select("query_id", grams("query")), reachable=found.select("query_id", grams("text")), oracle=oracle.select("query_id", grams("window_text")), selected=chosen.select("query_id", grams("window_text"))
    )
    return held.select("*", F.round(F.col("n_selected") / F.col("n_gold"), 6).alias("coverage"), F.round(F.try_divide("n_selected", "n_oracle"), 6).alias("efficiency"))


def stable_rankings(spark, sf_dir):
    """Into how many different rankings two trials of a search fall, one of which takes fewer results of every third query."""
    one = results_of(spark, sf_dir, "bm25").withColumn("trial", F.lit(0))
    two = one.where((F.col("query_id") % 3 != 0) | (F.col("rank") < LIMIT)).withColumn("trial", F.lit(1))
    return gates.stable_rankings(one.union(two))


def unfinished_trials(spark, sf_dir):
    """The trials of a matrix that events haven't finished: a type of event is a mode, its users' last digits are limits."""
    events = table(spark, sf_dir, "events")
    done = events.select(F.col("event_type").alias("mode"), (F.col("user_id") % 10).cast("int").alias("k"), (F.col("user_id") % 4).cast("int").alias("repetition")).distinct()
    return gates.open_trials(events.select(F.col("event_type").alias("mode")).distinct(), [1, 2, 5, 11], 4, done)


def input_checks(spark, sf_dir):
    """Whether the inputs of a run are what they were: counts, hashes and settings, and all of it together."""
    docs, cases = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    facts = docs.agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("d"), F.count_if(F.length("text") == 0).alias("e")).join(cases.agg(F.count("*").alias("c"), F.count_distinct(F.sha2("text", 256)).alias("h"), F.min(F.length("text")).alias("s")))
    found = gates.checks(facts, ids=F.col("n") == F.col("d"), texts=F.col("e") == 0, cases=F.col("c") >= 10, hashes=F.col("c") == F.col("h"), sizes=F.col("s") > 10_000)
    return found


def farthest_points(spark, sf_dir):
    """Five passages whose lengths lie far apart."""
    points = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("double").alias("position"))
    return gates.farthest(points, 5).select(F.col("id").alias("item_id"), "place")


def farthest_documents(spark, sf_dir):
    """Four documents of each source and language whose lengths lie far apart."""
    points = documents(spark, sf_dir).select("source", "lang", F.col("document_id").alias("id"), F.length("text").alias("position"))
    return gates.farthest(points, 4, "source", "lang")


def gold_mapping(spark, sf_dir):
    mapped = evidence.map_spans(stored(spans_of(spark, sf_dir), "spans"), chunks_of(spark, sf_dir))
    return mapped.withColumn("overlap_ratio", F.round("overlap_ratio", 6))


def paged(rows: DataFrame) -> DataFrame:
    """rows with the pages of 3,000 characters that their range touches."""
    first, last = F.floor(F.col("start_char") / 3000), F.floor((F.col("end_char") - 1) / 3000)
    return rows.withColumns({"page_start": (first + 1).cast("int"), "page_end": (last + 1).cast("int")})


def mixed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence spans of which a third have pages only, and a third neither pages nor a range; every seventh is of a source that isn't there."""
    rows = paged(spans_of(spark, sf_dir))
    kind = F.col("query_id") % 3
    ranges = {c: F.when(kind == 0, F.col(c)) for c in ("start_char", "end_char")}
    pages = {c: F.when(kind == 1, F.col(c)) for c in ("page_start", "page_end")}
    path = F.when(F.col("query_id") % 7 == 0, F.lit("elsewhere/0")).when(F.col("query_id") % 2 == 0, F.col("document_id").cast("string")).otherwise(F.col("source_path"))
    return rows.withColumns({**ranges, **pages, "source_path": path})


def gold_mapping_by_page(spark, sf_dir):
    """How spans with a range, with pages, or with neither map."""
    mapped = evidence.map_spans(mixed_spans(spark, sf_dir), paged(chunks_of(spark, sf_dir)), source_only=True)
    return mapped.withColumn("overlap_ratio", F.round("overlap_ratio", 6))


def unmatched_spans(spark, sf_dir):
    spans = stored(mixed_spans(spark, sf_dir), "spans")
    return evidence.unmatched_spans(spans, evidence.map_spans(spans, paged(chunks_of(spark, sf_dir)), source_only=True)).select("span_id")


def relevance_flags(spark, sf_dir):
    return evaluate.relevance(results_of(spark, sf_dir, "bm25"), gold_of(spark, sf_dir)).select("query_id", "rank", "chunk_id", "relevant")


def ndcg(spark, sf_dir):
    rows = metrics_of(spark, sf_dir, "bm25", K)
    return rows.select("query_id", "n_gold", "n_relevant", "first_rank", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("hit_rate", "recall", "precision", "mrr", "ndcg")})


def mixed_cases(spark: SparkSession, sf_dir: str, spans: DataFrame | None = None, mapped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases and gold, of which every third case has no gold but expects the sources of its passage, and one that isn't there."""
    spans = stored(spans_of(spark, sf_dir), "spans") if spans is None else spans
    gold = stored(gold_of(spark, sf_dir, spans, mapped), "gold")
    expected = spans.groupBy("query_id").agg(F.sort_array(F.collect_set(F.col("document_id").cast("string"))).alias("p"))
    paths = F.when(F.col("query_id") % 3 == 0, F.concat(F.coalesce("p", F.array().cast("array<string>")), F.array(F.lit("nowhere"))))
    cases = cases_of(spark, sf_dir).join(expected, "query_id", "left").select("query_id", paths.alias("expected_paths"))
    return cases, gold.where("query_id % 3 != 0")


def case_results(spark, sf_dir):
    cases, gold = mixed_cases(spark, sf_dir)
    rows = evaluate.case_results(cases, with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")), gold, K)
    return rows.withColumns({"relevant_ranks": F.array_join(F.transform("relevant_ranks", lambda r: r.cast("string")), ","), "reciprocal_rank": F.round("reciprocal_rank", 6)})


def retrieval_metrics(spark, sf_dir):
    """All metrics of BM25 at 5; an event's value stands for the latency of the case with its number."""
    spans = stored(spans_of(spark, sf_dir), "spans")
    found = stored(evidence.map_spans(spans, chunks_of(spark, sf_dir)), "mapped")
    cases, gold = mixed_cases(spark, sf_dir, spans, found)
    results = stored(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25", K)), "results")
    ranges = results.join(spans.select("span_id", "query_id", "document_id"), ["query_id", "document_id"]).select("span_id", "start_char", "end_char")
    covered = evidence.coverage(spans, ranges).join(spans.select("span_id", "query_id"), "span_id").groupBy("query_id").agg(F.bround(F.avg("coverage"), 4).alias("evidence_coverage"))
    mapped = found.select("span_id").distinct().withColumn("m", F.lit(1))
    mapping = spans.join(mapped, "span_id", "left").groupBy("query_id").agg(F.bround(F.count("m") / F.count("*"), 4).alias("mapping_coverage"))
    repeated = evaluate.duplicate_context(results).select("query_id", F.bround("duplicate_ratio", 4).alias("duplicate_ratio"))
    latency = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.bround("value", 4).alias("latency_ms"))
    rows = evaluate.case_results(cases, results, gold, K)
    for part in (covered, mapping, repeated, latency):
        rows = rows.join(part, "query_id", "left")
    return evaluate.all_metrics(rows, K)


def stage_latencies(spark, sf_dir):
    """Events as stages of traces."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("name"), F.col("value").alias("latency_ms"))
    return evaluate.stage_latencies(rows)


def compact_results(spark, sf_dir):
    rows = evaluate.compact_results(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25", K)))
    at = F.from_json("top", "array<struct<rank:int,chunk_id:string,source_path:string,preview:string>>")
    return rows.select("query_id", F.size(at).alias("n"), F.array_join(F.transform(at, lambda r: r["chunk_id"]), ",").alias("chunk_ids"), F.sha2(F.array_join(F.transform(at, lambda r: r["preview"]), "\n"), 256).alias("previews_sha256"))


def mode_comparison(spark, sf_dir):
    """Lexical and BM25 at 1, 3, 5 and 10."""
    gold, cases, counted = stored(gold_of(spark, sf_dir), "gold"), cases_of(spark, sf_dir), counted_of(spark, sf_dir)
    parts = None
    for mode in ("lexical", "bm25"):
        ranked = stored(results_of(spark, sf_dir, mode, counted=counted), "results")
        for k in (1, 3, 5, 10):
            part = evaluate.case_metrics(cases, ranked, gold, k).withColumns({"mode": F.lit(mode), "k": F.lit(k)})
            parts = part if parts is None else parts.union(part)
    return _rounded(evaluate.summary(parts, "mode", "k"))


def cutoff_metrics(spark, sf_dir):
    rows = evaluate.cutoffs(results_of(spark, sf_dir, "bm25"), gold_of(spark, sf_dir), [1, 3, 5, 10])
    return rows.withColumn("reciprocal", F.round("reciprocal", 6))


def failure_cases(spark, sf_dir):
    """Why cases fail when only the best result counts; of every fifth case the gold is taken for unmapped, every seventh expects a path."""
    chunks = chunks_of(spark, sf_dir).select("chunk_id", "source_path")
    results = results_of(spark, sf_dir, "bm25", 1).join(chunks, "chunk_id").where("query_id % 13 != 0")
    spans, gold = stored(spans_of(spark, sf_dir), "spans"), gold_of(spark, sf_dir)
    cut = F.col("query_id") % 5 == 0
    cases = cases_of(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 7 == 0, F.array(F.lit("nowhere"))).alias("expected_paths"))
    marked = spans.select("query_id", "span_id", "source_path", (~cut).alias("mapped"))
    return evaluate.failures(cases, results, gold.where(~cut), marked, 1)


def failure_breakdown(spark, sf_dir):
    return failure_cases(spark, sf_dir).groupBy("failure").agg(F.count("*").alias("n"))


def evidence_coverage(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    results = with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")).select("query_id", "document_id", "start_char", "end_char")
    ranges = results.join(spans.select("span_id", "query_id", "document_id"), ["query_id", "document_id"]).select("span_id", "start_char", "end_char")
    return evidence.coverage(spans, ranges).withColumn("coverage", F.round("coverage", 6))


def duplicate_context(spark, sf_dir):
    rows = evaluate.duplicate_context(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")))
    return rows.withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


def ngram_coverage(spark, sf_dir):
    """For each passage the share of its token trigrams that its first five results hold."""
    grams = cases_of(spark, sf_dir).select("query_id", F.explode(T.ngrams(T.tokens(F.col("query")), 3)).alias("g"))
    top = with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25").where(F.col("rank") <= K))
    held = top.select("query_id", F.explode(T.ngrams(T.tokens(F.col("text")), 3)).alias("g")).distinct().withColumn("held", F.lit(1))
    rows = grams.join(held, ["query_id", "g"], "left").groupBy("query_id").agg(F.count("held").alias("n_held"), F.count("*").alias("n_grams"))
    return rows.select("query_id", "n_held", "n_grams", F.round(F.col("n_held") / F.col("n_grams"), 6).alias("coverage"))


def latency_percentiles(spark, sf_dir):
    return evaluate.latencies(table(spark, sf_dir, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95")})


def metric_spread(spark, sf_dir):
    """Spread of the daily mean of event values, by type."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("value"))
    return evaluate.spread(daily, "event_type").withColumns({c: F.round(c, 6) for c in ("least", "greatest", "spread")})


def transitions(spark, sf_dir):
    """Lexical against BM25 at 5."""
    gold, counted = stored(gold_of(spark, sf_dir), "gold"), counted_of(spark, sf_dir)
    hits = [metrics_of(spark, sf_dir, mode, K, gold, counted).select("query_id", (F.col("n_relevant") > 0).alias("hit")) for mode in ("lexical", "bm25")]
    return evaluate.transitions(*hits)


def screen_transitions(spark, sf_dir):
    """Events of users as trials of a baseline: a type of event is a trial, a value above 50 a hit; the candidate hits above 60 on average."""
    events = table(spark, sf_dir, "events")
    trials = events.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("trial")).agg((F.max("value") > 50).alias("hit"))
    candidate = events.groupBy(F.col("user_id").alias("query_id")).agg((F.avg("value") > 60).alias("hit"))
    canaries = candidate.where("query_id % 10 = 0").select("query_id")
    return evaluate.screen_transitions(trials, candidate, canaries)


def heldout_overlap(spark, sf_dir):
    """Labelled documents whose text also stands among unlabelled ones."""
    docs = documents(spark, sf_dir).select("document_id", F.sha2("text", 256).alias("h"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    others = docs.join(known, "document_id", "left_anti").select("h").distinct()
    return docs.join(known, "document_id", "left_semi").join(others, "h", "left_semi").select("document_id")


def review_merge(spark, sf_dir):
    """Passages after a review that corrects every third; an odd id changes the query too."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.substring("text", 1, 10).alias("answer"))
    wrong = F.col("query_id") % 3 == 0
    new_query = F.when(wrong & (F.col("query_id") % 2 == 1), F.upper("query"))
    decisions = cases.select("query_id", F.when(wrong, "corrected").otherwise("approved").alias("decision"), gates.case_hash(F.col("query"), F.col("answer")).alias("original_hash"), new_query.alias("new_query"), F.when(wrong, "better").alias("new_answer"))
    rows = gates.review(cases, decisions)
    return rows.select("query_id", F.sha2("query", 256).alias("query_sha256"), "answer", "changed")


def rule_violations(spark, sf_dir):
    """Events that break bounds."""
    rows = table(spark, sf_dir, "events")
    return gates.violations(rows, "event_id", 5, low=F.col("value") < 60, typed=F.col("event_type").isNotNull(), even=F.col("event_id") % 2 == 0)


def generated_cases(spark, sf_dir):
    """Questions made of passages by a stand-in for a service, whose answer to every fifth is no JSON and to every seventh lacks a field."""

    def generate(prompts: DataFrame) -> DataFrame:
        words = F.slice(F.split(F.substring_index("prompt", "\n\n", -1), " "), 1, 4)
        good = F.to_json(F.struct(F.concat(F.lit("What of "), F.array_join(words, " "), F.lit("?")).alias("question"), F.array_join(F.slice(words, 1, 2), " ").alias("answer")))
        return prompts.select("span_id", F.when(F.col("span_id") % 5 == 0, "no idea").when(F.col("span_id") % 7 == 0, '{"question": "x"}').otherwise(good).alias("answer"))

    cases, _ = gates.generated_cases(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("span_id"), "text"), generate)
    return cases


def screen_gates(spark, sf_dir):
    """Events as cases of two modes at two limits: their type, number and value stand for mode, trial and hit."""
    e = table(spark, sf_dir, "events")
    mode, k = F.when(F.col("event_id") % 2 == 0, "semantic").otherwise("hybrid"), F.when(F.col("event_id") % 4 < 2, 5).otherwise(20)
    rows = e.groupBy(mode.alias("mode"), k.alias("k"), F.col("user_id").alias("query_id")).agg(
        F.count_if((F.col("event_id") % 3 > 0) & (F.col("value") > 50)).alias("baseline_hits"), F.count_if(F.col("event_id") % 3 > 0).alias("n_trials"), F.count_if((F.col("event_id") % 3 == 0) & (F.col("value") > 50)).alias("c"),
        F.sum(F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100)).alias("candidate_tokens"), F.sum(F.when(F.col("event_id") % 3 == 1, F.col("event_id") % 100)).alias("baseline_tokens"),
    )
    rows = rows.withColumns({
        "role": F.when(F.col("query_id") % 3 == 0, "stable").otherwise("challenge"), "candidate_hit": F.col("c") > 0, "baseline_missed_source": F.col("query_id") % 5 == 0,
        "candidate_failure": F.when((F.col("c") == 0) & (F.col("query_id") % 10 < 3), "missed_source"),
    })
    return gates.screen_gates(rows).withColumn("value", F.round("value", 6))


def cache_report(spark, sf_dir):
    """How many chunks have a vector when those of every other document are known."""
    chunks = chunks_of(spark, sf_dir)
    known = chunks.where("document_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"))
    return providers.cache_report(chunks, known)


def case_files(spark, sf_dir):
    """Passages as evaluation cases, written as JSON lines and read back; what a case holds beside goes to its metadata."""
    path = new_folder(spark, "cases")
    rows = table(spark, sf_dir, "benchmark").select(F.format_string("case-%05d", "item_id").alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("src/"), F.col("item_id").cast("string"))).alias("expected_source_paths"), F.length("text").alias("size"))
    files.write_cases(rows, path)
    got = files.evaluation_cases(spark, path)
    return got.select("id", F.sha2("query", 256).alias("query_sha256"), F.col("expected_source_paths")[0].alias("path"), F.col("metadata")["size"].alias("size"))


def trace_files(spark, sf_dir):
    """Traces of sessions, written as JSON lines, one looked up again."""
    path = new_folder(spark, "traces")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    made = rows.select(F.format_string("ask-%d", "conv_id").alias("trace_id"), F.lit("ask").alias("operation"), F.lit("success").alias("status"), F.lit("2024").alias("started_at"), F.lit("2024").alias("finished_at"), F.create_map(F.lit("turns"), F.col("n").cast("string")).alias("details"))
    files.write_traces(made, path)
    everything = files.traces(spark, path)[0].union(files.find_trace(spark, path, "ask-1"))
    return everything.select("trace_id", "operation", F.col("details")["turns"].alias("turns"))


def run_files(spark, sf_dir):
    """A run's cases, written with its summary and failures, and read back."""
    cases, gold = mixed_cases(spark, sf_dir)
    rows = stored(evaluate.case_results(cases, with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")), gold, K), "cases")
    failed = rows.where("rank is null").groupBy(F.lit("missed").alias("failure")).agg(F.count("*").alias("n"))
    path = files.write_run(new_folder(spark, "runs"), "bm25", evaluate.all_metrics(rows, K), rows, failed)
    back = spark.read.schema("query_id long, passed boolean").json(f"{path}/cases.jsonl").groupBy("passed").agg(F.count("*").alias("n"))
    lost = spark.read.schema("query_id long, passed boolean").json(f"{path}/failures.jsonl").agg(F.count("*").alias("n_failures"))
    lines = spark.read.text(f"{path}/summary.md").agg(F.count("*").alias("n_lines"))
    return back.join(F.broadcast(lost)).join(F.broadcast(lines))


def normal_chunks(spark, sf_dir):
    """Turns of conversations under other names, as chunks."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.col("turn").cast("string").alias("index"), F.lit("text/plain").alias("media_type"))
    got = files.normal_chunks(rows)
    return got.select("chunk_id", "document_id", "chunk_index", "media_type", "strategy", F.sha2("text", 256).alias("text_sha256"))


def redacted_metadata(spark, sf_dir):
    """Nested metadata as JSON, without the keys that name secrets."""
    k = F.col("doc_id")
    made = F.to_json(F.struct(k.alias("id"), F.lit("x").alias("api_key"), F.struct((k % 5).alias("n"), F.lit("y").alias("authToken")).alias("inner"), F.array(F.struct(F.lit("z").alias("Password"), (k % 3).alias("m"))).alias("list")))
    return table(spark, sf_dir, "documents").select("doc_id", U.without_secrets(made).alias("metadata"))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; of each assistant's turn the length tells the source, and every fifth turn of a session failed."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    sources = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("notes/"), (F.length("text") % 7).cast("string"), F.lit(".md"))))
    return rows.withColumns({"sources": sources, "status": F.when(F.col("turn") % 5 == 4, "failed").otherwise("success")})


def session_summary(spark, sf_dir):
    return history.summarize(turns_of(spark, sf_dir))


def session_append(spark, sf_dir):
    """The first two turns of every session after all of them, as new ones."""
    turns = turns_of(spark, sf_dir).select("session_id", "turn", "role", "text")
    grown = history.append(turns, turns.where("turn < 2"))
    return grown.groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.sha2(F.max_by("text", "turn"), 256).alias("last_sha256"))


def session_changes(spark, sf_dir):
    """Sessions after one is renamed and pinned, another starred, and a third deleted."""
    rows = history.summarize(turns_of(spark, sf_dir)).select("session_id", "title", F.lit(False).alias("pinned"), F.lit(False).alias("starred"))
    rows = history.changed(history.changed(rows, 1, title="A new title", pinned=True), 2, starred=True)
    return history.without(rows, 3)


def session_filters(spark, sf_dir):
    """How many sessions each filter leaves."""
    rows = stored(history.summarize(turns_of(spark, sf_dir)).withColumns({"pinned": F.col("session_id") % 10 == 0, "starred": F.col("session_id") % 7 == 0}), "sessions")
    parts = [history.filtered(rows, kind).agg(F.lit(kind).alias("filter"), F.count("*").alias("n")) for kind in ("recent", "pinned", "starred", "failed", "has-sources")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def search_traces(spark, sf_dir):
    """A trace of each query's BM25 results."""
    rows = history.traced(results_of(spark, sf_dir, "bm25"), "search", "query_id")
    return rows.select("trace_id", "operation", "status", *(F.col("details")[k].alias(k) for k in ("n_results", "n_chunks")), F.round(F.col("details")["best_score"].cast("double"), 4).alias("best_score"))


def session_branch(spark, sf_dir):
    return history.branch(turns_of(spark, sf_dir), 1).select("session_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


def session_search(spark, sf_dir):
    return history.search(turns_of(spark, sf_dir), "notes/3")


def session_export(spark, sf_dir):
    return history.export(turns_of(spark, sf_dir)).select("session_id", F.sha2("markdown", 256).alias("markdown_sha256"))


def trace_list(spark, sf_dir):
    traces = table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("operation"), F.col("ts").alias("started_at"))
    return history.newest(traces, 20)


def schema_migrate(spark, sf_dir):
    version = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise((F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", version.alias("schema_version"), version.alias("before"))
    return history.migrate(rows).groupBy("before", "schema_version").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_stats, lexical_search, bm25_search, cosine_pairs, semantic_search, hybrid_rrf, dedup_candidates, metadata_redact, retrieval_stages, ranking_rehydrate,
        token_budget_prefix, context_pack, prompt_render, budget_frontier, fragment_allocation, fragment_windows, fragment_scores, fragment_contexts, evidence_windows, fragment_evidence, stable_rankings, unfinished_trials, input_checks, farthest_documents, farthest_points,
        gold_mapping, gold_mapping_by_page, unmatched_spans, relevance_flags, ndcg, case_results, retrieval_metrics, stage_latencies, compact_results,
        mode_comparison, cutoff_metrics, failure_cases, failure_breakdown, evidence_coverage, duplicate_context, ngram_coverage, latency_percentiles, metric_spread, transitions, screen_transitions,
        heldout_overlap, review_merge, rule_violations, generated_cases, screen_gates, cache_report, case_files, trace_files, run_files, normal_chunks, redacted_metadata, session_append,
        session_changes, session_filters, search_traces, session_summary, session_branch, session_search, session_export, trace_list, schema_migrate,
    )
}

W = r"[\p{L}\p{N}_]+"
CASES = "cases as (select item_id query_id, text query from benchmark)"


def _ranked(table_: str, prefix: str, limit: int, k: str = "chunk_id") -> str:
    return (
        f"{prefix} as (select query_id, rank, {k}, score from (select *, (row_number() over (partition by query_id order by round(score, 9) desc, {k}))::int rank"
        f" from {table_}) where rank <= {limit})"
    )


def _bm25(source: str, limit: int, name: str = "bm25", key: str = "chunk_id") -> str:
    """CTEs from ``source`` (key, text) and cases to the ranked results ``name``, and the lexical ones under ``lexical``."""
    return f"""words as (select {key}, len(w) dl, w from (select {key}, regexp_extract_all(lower(text), '{W}') w from {source}))
, stats as (select count(*) n, avg(dl) avgdl from words)
, post as (select {key}, dl, token, count(*) tf from (select {key}, dl, unnest(w) token from words) group by all)
, q as (select query_id, token, count(*) qtf from (select query_id, unnest(regexp_extract_all(lower(query), '{W}')) token from cases) group by all)
, df as (select token, count(*) df from post group by token)
, bm25_all as (select query_id, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
  from q join post using (token) join df using (token), stats group by query_id, {key})
, lexical_all as (select query_id, {key}, sum(tf)::double score from q join post using (token) group by query_id, {key})
, {_ranked("bm25_all", name, limit, key)}, {_ranked("lexical_all", "lexical", limit, key)}"""


RANKED = f"{CHUNKS}, {CASES}, {_bm25('chunks', LIMIT)}"
TWICE = f"{CHUNKS}, {CASES}, {_bm25('chunks', 2 * LIMIT)}"
SPANS = """spots as (select query_id, query, document_id, source_path, unnest(list_filter(range(0, length(t) - length(query) + 1), lambda i: substr(t, i + 1, length(query)) = query)) pos
    from docs join cases on contains(t, query) where query <> '')
  , spans as (select query_id || '-' || document_id || case when pos = min(pos) over (partition by query_id, document_id) then '' else '-' || pos end span_id, query_id, document_id, source_path,
    pos::int s, (pos + length(query))::int e from spots)"""
MAPPED = SPANS + (
    ", mapped as (select span_id, query_id, chunk_id, greatest(0, least(e, end_char) - greatest(s, start_char)) / (e - s)::double overlap_ratio"
    " from spans join chunks using (document_id) where greatest(0, least(e, end_char) - greatest(s, start_char)) / (e - s)::double >= 0.3)"
    ", gold as (select distinct query_id, chunk_id from mapped)"
)
MIXED = MAPPED + """
  , pc as (select *, start_char // 3000 + 1 p1, (end_char - 1) // 3000 + 1 p2 from chunks)
  , ms as (select *, query_id % 3 kind, s // 3000 + 1 q1, (e - 1) // 3000 + 1 q2, case when query_id % 7 = 0 then 'elsewhere/0' when query_id % 2 = 0 then document_id::varchar else source_path end path from spans)
  , met as (select ms.*, chunk_id, start_char, end_char, p1, p2, case when path = pc.source_path then 'exact' else 'suffix' end k from ms join pc
    on path = pc.source_path or ends_with(pc.source_path, '/' || path) or ends_with(path, '/' || pc.source_path))
  , mixed_map as (
    select span_id, chunk_id, (least(e, end_char) - greatest(s, start_char)) / (e - s)::double r, 'char_overlap' "method", k kind from met where kind = 0 and (least(e, end_char) - greatest(s, start_char)) / (e - s)::double >= 0.3
    union all select span_id, chunk_id, null, 'page_overlap', k from met where kind = 1 and p1 <= q2 and q1 <= p2
    union all select span_id, chunk_id, null, 'source_only', k from met where kind = 2)"""
CASE_RESULTS = MAPPED + f""", pths as (select query_id, case when query_id % 3 = 0 then list_append(coalesce(p, []), 'nowhere') else [] end p from cases left join (
    select query_id, list_sort(list(distinct document_id::varchar)) p from spans group by query_id) using (query_id))
  , g3 as (select * from gold where query_id % 3 <> 0), ng as (select query_id, count(*) n from g3 group by query_id)
  , rs as (select query_id, rank, chunk_id, source_path, document_id::varchar d, length(text) n_chars, (g3.chunk_id is not null)::int gr from bm25 join chunks using (chunk_id) left join g3 using (query_id, chunk_id) where rank <= {K})
  , rp as (select *, coalesce(ng.n, 0) n_gold, len(list_filter(p, lambda x: source_path = x or ends_with(source_path, '/' || x))) > 0 hit,
      row_number() over (partition by query_id, d order by rank) = 1 fresh from rs join pths using (query_id) left join ng using (query_id))
  , fl as (select *, case when n_gold > 0 then gr when hit and fresh then 1 else 0 end f from rp)
  , ag as (select query_id, list(rank order by rank) filter (where f = 1) rr, min(rank) filter (where gr = 1) cr, min(rank) filter (where hit) sr, count(*) n, sum(n_chars) c, sum(n_chars) filter (where f = 1) rc from fl group by query_id)
  , cr as (select query_id, coalesce(cr, sr)::int rank, case when cr is not null then 'chunk_id' when sr is not null then 'source_path' else 'none' end matched_by, coalesce(1.0::double / coalesce(cr, sr), 0) reciprocal_rank,
      coalesce(ag.n, 0)::int n_retrieved, (case when coalesce(ng.n, 0) > 0 then ng.n else len(p) end)::bigint n_expected, coalesce(len(rr), 0)::int n_relevant, coalesce(rr, []) rr,
      round_even(case when coalesce(ng.n, 0) > 0 then coalesce(len(rr), 0) / ng.n::double else 0 end, 4) recall, round_even(coalesce(len(rr), 0) / {K}.0::double, 4) "precision",
      case when n_expected > 0 then round_even(coalesce(list_sum(list_transform(rr, lambda r: 1 / log2(r + 1.0))), 0) / list_sum(list_transform(range(1, least(n_expected, {K}) + 1), lambda r: 1 / log2(r + 1.0))), 4) else 0.0 end ndcg,
      case when coalesce(c, 0) > 0 then round_even(coalesce(rc, 0) / c::double, 4) else 0.0 end density, coalesce(c, 0)::bigint context_chars, ceil(coalesce(c, 0) / 4.0)::bigint context_tokens
    from pths left join ag using (query_id) left join ng using (query_id))"""
FLAGS = ", flags as (select r.*, (g.chunk_id is not null)::int relevant from bm25 r left join gold g using (query_id, chunk_id))"


FAILED = """, f1 as (select query_id, chunk_id, source_path from bm25 join chunks using (chunk_id) where rank = 1 and query_id % 13 <> 0), g5 as (select * from gold where query_id % 5 <> 0)
  , fs as (select query_id, count(*) n from spans group by query_id), fn as (select query_id, count(*) n from f1 join (select distinct query_id, source_path p from spans) using (query_id) where source_path = p or ends_with(source_path, '/' || p) group by query_id)
  , fh as (select query_id, count(*) n from f1 join g5 using (query_id, chunk_id) group by query_id), fg as (select query_id, count(*) n from g5 group by query_id)
  , fc as (select query_id, case when coalesce(fh.n, 0) > 0 then 'passed' when f1.chunk_id is null then 'no_result' when coalesce(fs.n, 0) > 0 and query_id % 5 = 0 then 'unmapped_evidence'
      when query_id % 7 = 0 or coalesce(fs.n, 0) > 0 and coalesce(fn.n, 0) = 0 then 'missed_source' when coalesce(fg.n, 0) > 0 and coalesce(fn.n, 0) > 0 then 'wrong_section' when coalesce(fg.n, 0) > 0 then 'low_rank' else 'unknown' end failure
    from cases left join f1 using (query_id) left join fs using (query_id) left join fn using (query_id) left join fh using (query_id) left join fg using (query_id))"""


def _metrics(ranked: str, k: int, name: str) -> str:
    return f"""{name} as (
  select query_id, coalesce(n_gold, 0) n_gold, coalesce(n_relevant, 0) n_relevant, first_rank, case when n_gold > 0 then coalesce(n_relevant, 0) / n_gold::double else 0.0 end recall,
    coalesce(n_relevant, 0) / {k}.0::double "precision", coalesce(1.0 / first_rank, 0.0)::double reciprocal_rank,
    case when n_gold > 0 then coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda r: 1 / log2(r + 1.0))) else 0.0 end ndcg
  from cases left join (select query_id, count(*) n_gold from gold group by query_id) using (query_id)
  left join (select query_id, count(*) n_relevant, min(rank) first_rank, sum(1 / log2(rank + 1.0)) dcg from {ranked} join gold using (query_id, chunk_id) where rank <= {k} group by query_id) using (query_id))"""


SUMMARY = 'count(*) n_cases, round(avg((n_relevant > 0)::int), 6) hit_rate, round(avg(round(recall, 4)), 6) recall, round(avg("precision"), 6) "precision", round(avg(reciprocal_rank), 6) mrr, round(avg(round(ndcg, 4)), 6) ndcg'
VECTORS = "v as (select vec_id, embedding::double[] x from embeddings), u as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) n from v)"
COS = "case when a.n = 0 or b.n = 0 then 0.0 else list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) / (a.n * b.n) end"
SPACED = "[ \\t\\n\\x0B\\f\\r]+"
FULL = f"with {RANKED}, {MAPPED}{FLAGS}"
WITH_TEXT = f"with {RANKED}, t as (select b.*, c.document_id, c.start_char, c.end_char, c.text from bm25 b join chunks c using (chunk_id))"
RUN = "sum(length(text)) over (partition by query_id order by rank)"
FOLD = "replace(lower({0}), 'ß', 'ss')"
STOPS = "[" + ", ".join(f"'{w}'" for w in selection.STOP_WORDS) + "]"
#: Recursive CTEs: characters dealt in rounds over lists of caps, and the windows of every result.
FRAGMENTS = f"""with recursive {RANKED}, t0 as (select query_id, rank, chunk_id, query, text, '[rank=' || rank || ' source=' || document_id || ' page=' || (start_char // 3000 + 1) || ']' header
    from bm25 join chunks using (chunk_id) join cases using (query_id))
  , cap as (select query_id, list(least(length(text), 640) order by rank) c, list(rank order by rank) r, 3072 - sum(length(header) + 1) - 2 * (count(*) - 1) av from t0 group by query_id)
  , deal as (select query_id, c, r, list_transform(c, lambda x: 0::bigint) g, av::bigint l, 0 i from cap
    union all select query_id, c, r, list_transform(g, lambda x, k: x + give[k]) g, (l - list_sum(give))::bigint, i + 1 from (
      select *, list_transform(g, lambda x, k: case when x < c[k] then least(c[k] - x, l // n + case when list_sum(open_[1:k]) - 1 < l % n then 1 else 0 end) else 0 end) give from (
        select *, greatest(list_sum(open_), 1)::bigint n from (select *, list_transform(g, lambda x, k: (x < c[k])::int) open_ from deal where i <= len(c) and l > 0))))
  , dealt as (select query_id, unnest(r) rank, unnest(g) allocation from (select *, row_number() over (partition by query_id order by i desc) z from deal) where z = 1)
  , fr as (select t0.*, allocation::int allocation from t0 join dealt using (query_id, rank))
  , cutp as (select query_id, chunk_id, text, allocation a, length(text) n, regexp_split_to_array(text, '(?:[.!?;:](?:\\n+|[\\s]+))|\\n+') p, regexp_extract_all(text, '(?:[.!?;:](?:\\n+|[\\s]+))|\\n+') m from fr)
  , bnd as (select query_id, chunk_id, text, a, n, list_distinct(list_prepend(0, list_transform(range(1, len(p) + 1), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0)))) b from cutp)
  , unt as (select query_id, chunk_id, text, a, n, list_sort(b) b from bnd)
  , sts as (select query_id, chunk_id, text, a, n, b, unnest(list_distinct(list_append(flatten(list_transform(range(1, len(b)), lambda k: case when b[k + 1] - b[k] > a then range(b[k]::bigint, b[k + 1]::bigint, 112) else [b[k]::bigint] end)), greatest(0, n - a)::bigint))) s from unt where n > a)
  , trm as (select *, s + length(regexp_extract(substr(text, s + 1), '^[\\s]*')) st from sts)
  , lim as (select *, coalesce(list_max(list_filter(b, lambda x: x >= st + greatest(1, a // 2) and x <= least(n, st + a))), least(n, st + a)) en from trm)
  , win as (select distinct query_id, chunk_id, st::int ws, (st + length(regexp_replace(substr(text, st + 1, (en - st)::bigint), '[\\s]+$', '')))::int we, regexp_replace(substr(text, st + 1, (en - st)::bigint), '[\\s]+$', '') wt from lim
    where length(regexp_replace(substr(text, st + 1, (en - st)::bigint), '[\\s]+$', '')) > 0
    union all select query_id, chunk_id, 0, n, text from unt where n <= a and n > 0)"""
SCORED = f"""{FRAGMENTS}, tk as (select query_id, regexp_extract_all({FOLD.format('query')}, '{W}') q0 from cases)
  , q1 as (select query_id, q0, case when len(list_filter(q0, lambda x: not list_contains({STOPS}, x))) > 0 then list_filter(q0, lambda x: not list_contains({STOPS}, x)) else q0 end q from tk)
  , sc as (select win.*, rank, header, q, q0, regexp_extract_all({FOLD.format('wt')}, '{W}') w, regexp_extract_all({FOLD.format('substr(text, 1, 60)')}, '{W}') sg from win join fr using (query_id, chunk_id) join q1 using (query_id))
  , gr as (select *, list_transform(range(1, len(q)), lambda k: q[k] || ' ' || q[k + 1]) q2, list_transform(range(1, len(q0)), lambda k: q0[k] || ' ' || q0[k + 1]) e2, list_transform(range(1, len(q0) - 1), lambda k: q0[k] || ' ' || q0[k + 1] || ' ' || q0[k + 2]) e3,
      list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) w2, list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) w3 from sc)
  , nq as (select *, len(list_distinct(list_intersect(q, w)))::int u, len(list_filter(w, lambda x: list_contains(q, x)))::int o, len(list_distinct(list_intersect(q2, w2)))::int b, len(list_distinct(list_intersect(list_intersect(q, w), sg)))::int g,
      len(list_distinct(list_intersect(e3, w3)))::int eu, len(list_filter(w, lambda x: list_contains(q0, x)))::int eo, len(list_distinct(list_intersect(e2, w2)))::int eb from gr)
  , bq as (select * from (select *, row_number() over (partition by query_id, chunk_id order by u desc, o desc, b desc, g desc, we - ws desc, ws) z from nq) where z = 1)
  , be as (select * from (select *, row_number() over (partition by query_id, chunk_id order by eu desc, eo desc, eb desc, we - ws desc, ws) z from nq) where z = 1)"""
SQL = {
    "corpus_stats": f"""with {CHUNKS}, w as (select regexp_extract_all(lower(text), '{W}') w from chunks)
      select count(*) n_chunks, round(avg(len(w)), 6) avg_length, sum(len(w))::bigint n_tokens, (select count(distinct x) from (select unnest(w) x from w)) n_distinct from w""",
    "lexical_search": f"with {RANKED} select query_id, rank, chunk_id, round(score, 6) score from lexical",
    "bm25_search": f"with {RANKED} select query_id, rank, chunk_id, round(score, 6) score from bm25",
    "cosine_pairs": f"with {VECTORS} select a.vec_id, round({COS}, 6) cosine from u a join u b on b.vec_id = a.vec_id + 1",
    "semantic_search": f"""with {VECTORS}, s as (select a.vec_id query_id, b.vec_id chunk_id, {COS} score from u a, u b where a.vec_id % 20 = 0), {_ranked("s", "r", LIMIT)}
      select query_id, rank, chunk_id, round(score, 6) score from r""",
    "hybrid_rrf": f"""with {DOCS}, {CASES}, whole as (select document_id chunk_id, t as text from docs), {_bm25("whole", 40)}, {VECTORS}
      , s as (select a.vec_id query_id, b.vec_id chunk_id, {COS} score from u a join cases on a.vec_id = query_id, u b join whole on b.vec_id = chunk_id), {_ranked("s", "dense", 40)}
      , f as (select query_id, chunk_id, a.rank sparse_rank, b.rank dense_rank, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) score, least(a.rank, b.rank) best
        from bm25 a full join dense b using (query_id, chunk_id)), g as (select *, (row_number() over (partition by query_id order by round(score, 12) desc, best, chunk_id))::int rank from f)
      select query_id, rank, chunk_id, round(score, 9) score, sparse_rank, dense_rank, case when sparse_rank is null or dense_rank < sparse_rank then 'dense' else 'sparse' end origin from g where rank <= 10""",
    "dedup_candidates": f"""with {RANKED}, b as (select query_id, rank, chunk_id from lexical union all select query_id, rank + 10, chunk_id from bm25
      ), f as (select query_id, chunk_id, min(rank) r from b group by all) select query_id, (row_number() over (partition by query_id order by r))::int rank, chunk_id from f""",
    "metadata_redact": """with k as (select doc_id document_id, ['page_' || lang, case when doc_id % 4 = 0 then 'text_context' else 'section' end, case when doc_id % 4 = 1 then 'api_key' else 'title' end,
      case when doc_id % 4 = 2 then 'Authorization' else 'level' end, lang || '_vector'] n from documents)
      , h as (select document_id, list_filter(n, lambda x: not regexp_matches(lower(x), 'api_key|secret|token|authorization|embedding|vector|text')) k from k)
      select document_id, array_to_string(list_sort(k), ',') keys, array_to_string(list_sort(list_transform(k, lambda x: upper(x))), ',') held from h""",
    "retrieval_stages": f"""with {RANKED}, t as (select query_id, rank, {RUN} run from bm25 join chunks using (chunk_id)), n as (select (select count(*) from cases) c, (select count(*) from cases where trim(query) <> '') a,
        (select count(*) from bm25) b, (select count(*) from t where run <= 1024) k)
      select i::int stage_index, s stage, case when s = 'rerank' then 'skipped' else 'done' end status, case i when 0 then c when 1 then a else b end n_in, case i when 0 then a when 5 then k else b end n_out
      from n, (select unnest(range(6)) i, unnest(['normalize', 'candidates', 'deduplicate', 'rerank', 'select', 'budget']) s)""",
    "ranking_rehydrate": f"{WITH_TEXT} select query_id, rank, chunk_id, document_id, start_char::int start_char, end_char::int end_char, sha256(text) text_sha256 from t",
    "token_budget_prefix": f"{WITH_TEXT}, r as (select query_id, rank, chunk_id, ({RUN})::bigint running_chars from t) select * from r where running_chars <= 4096",
    "context_pack": f"""{WITH_TEXT}, r as (select *, {RUN} - length(text) before from t), p as (select query_id, rank, chunk_id, substr(text, 1, (4000 - before)::bigint) x from r where before < 4000)
      select query_id, rank, chunk_id, length(x)::int n_chars, sha256(x) text_sha256 from p""",
    "prompt_render": f"""{WITH_TEXT}, r as (select *, {RUN} - length(text) before from t), p as (select query_id,
      string_agg('[' || rank || '] ' || chunk_id || ' (score ' || regexp_replace(printf('%.4f', score), '\\.?0+$', '') || ')' || chr(10) || substr(text, 1, (4000 - before)::bigint), chr(10) || chr(10) order by rank) x from r where before < 4000 group by query_id)
      , a as (select query_id, x || chr(10) || chr(10) || 'Question: ' || query x from p join cases using (query_id)) select query_id, sha256(x) prompt_sha256, length(x)::int n_chars from a""",
    "fragment_allocation": f"{FRAGMENTS} select query_id, rank, length(text)::int n_chars, allocation from fr",
    "fragment_windows": f"{FRAGMENTS} select query_id, chunk_id, ws window_start, we window_end, sha256(wt) text_sha256 from win",
    "fragment_scores": f"{SCORED} select query_id, chunk_id, ws window_start, we window_end, u n_unique, o n_occurrences, b n_bigrams, g n_signals from bq",
    "fragment_contexts": f"""{SCORED}, rn as (select query_id, string_agg(header || chr(10) || wt, chr(10) || chr(10) order by rank) x from bq group by query_id)
      select query_id, sha256(x) context_sha256, length(x)::int n_chars, 0::bigint n_lost from rn""",
    "evidence_windows": f"{SCORED} select query_id, chunk_id, ws window_start, we window_end, eu n_trigrams, eo n_occurrences, eb n_bigrams from be",
    "budget_frontier": f"""{FULL}, r as (select query_id, relevant, {RUN} run from flags join chunks using (chunk_id)), b as (select unnest([256, 512, 768, 1024, 1400, 2048]) budget)
      select budget, count(*) filter (where run <= 4 * budget) n_kept, count(*) filter (where relevant = 1 and run > 4 * budget) n_lost, count(*) n_all from r, b group by budget""",
    "gold_mapping": f"with {CHUNKS}, {CASES}, {MAPPED} select span_id, chunk_id, round(overlap_ratio, 6) overlap_ratio, 'char_overlap' \"method\", 'exact' kind from mapped",
    "gold_mapping_by_page": f"with {CHUNKS}, {CASES}, {MIXED} select span_id, chunk_id, round(r, 6) overlap_ratio, \"method\", kind from mixed_map",
    "unmatched_spans": f"with {CHUNKS}, {CASES}, {MIXED} select span_id from spans where span_id not in (select span_id from mixed_map)",
    "relevance_flags": f"{FULL} select query_id, rank, chunk_id, relevant from flags",
    "ndcg": f"""with {RANKED}, {MAPPED}, {_metrics("bm25", K, "m")} select query_id, n_gold, n_relevant, first_rank, round(recall, 6) recall, round("precision", 6) "precision",
      round(reciprocal_rank, 6) reciprocal_rank, round(ndcg, 6) ndcg from m""",
    "case_results": f"""with {RANKED}, {CASE_RESULTS} select query_id, rank, matched_by, round(reciprocal_rank, 6) reciprocal_rank, n_retrieved, n_expected, n_relevant, array_to_string(rr, ',') relevant_ranks,
      recall, "precision", ndcg, density, context_chars, context_tokens from cr""",
    "retrieval_metrics": f"""with {RANKED}, {CASE_RESULTS}
      , rv as (select span_id, greatest(start_char, s) a, least(end_char, e) b from spans join (select query_id, document_id, start_char, end_char from bm25 join chunks using (chunk_id) where rank <= {K}) using (query_id, document_id)
        where greatest(start_char, s) < least(end_char, e))
      , px as (select span_id, count(distinct x) n from (select span_id, unnest(range(a, b)) x from rv) group by span_id)
      , ev as (select query_id, round_even(avg(coalesce(n, 0) / (e - s)::double), 4) v from spans left join px using (span_id) group by query_id)
      , mp as (select query_id, round_even(count(m.span_id) / count(*)::double, 4) v from spans left join (select distinct span_id from mapped) m using (span_id) group by query_id)
      , fx as (select query_id, rank, trim(regexp_replace(lower(text), '{SPACED}', ' ', 'g')) x from bm25 join chunks using (chunk_id) where rank <= {K})
      , sx as (select distinct query_id, rank, substr(x, i, 20) g from (select *, unnest(range(1, greatest(length(x) - 19, 1) + 1)) i from fx))
      , du as (select query_id, round_even((count(*) - count(distinct g)) / count(*)::double, 4) v from sx group by query_id)
      , lt as (select event_id query_id, round_even(value, 4) v from events)
      , al as (select cr.*, ev.v ev, mp.v mp, coalesce(du.v, 0) du, lt.v lt from cr left join ev using (query_id) left join mp using (query_id) left join du using (query_id) left join lt using (query_id))
      select """
    + ", ".join(f"round_even(avg(coalesce(rank <= {n}, false)::int), 4) hit_{m}" for n, m in ((1, "1"), (3, "3"), (5, "5"), (K, "k")))
    + ", "
    + ", ".join(f"round_even(avg(len(list_filter(rr, lambda r: r <= {n})) / {n}.0::double), 4) precision_{m}" for n, m in ((1, "1"), (3, "3"), (5, "5"), (K, "k")))
    + """, round_even(avg(reciprocal_rank), 4) mrr, round_even(avg(recall), 4) recall_k, round_even(avg(ndcg), 4) ndcg_k, round_even(coalesce(avg(ev), 0), 4) evidence_coverage_k,
      round_even(avg((ev is not null)::int), 4) evidence_coverage_case_rate, round_even(coalesce(avg(mp), 0), 4) mapping_coverage, round_even(avg((mp is not null)::int), 4) mapping_coverage_case_rate,
      round_even(avg(density), 4) context_density, round_even(avg(du), 4) duplicate_ratio, round_even(coalesce(avg(lt), 0), 4) latency_mean, round_even(quantile_cont(lt, 0.5), 4) latency_p50, round_even(quantile_cont(lt, 0.95), 4) latency_p95,
      round_even(avg(n_retrieved), 4) retrieved, round_even(avg(context_chars), 4) context_chars, round_even(avg(context_tokens), 4) context_tokens from al""",
    "stage_latencies": """select event_type "name", count(*) samples, round_even(avg(value), 4) mean, round_even(quantile_cont(value, 0.5), 4) p50, round_even(quantile_cont(value, 0.95), 4) p95
      from events where event_id % 11 <> 0 group by event_type""",
    "compact_results": f"""{WITH_TEXT} select query_id, count(*)::int n, string_agg(chunk_id, ',' order by rank) chunk_ids,
      sha256(string_agg(substr(regexp_replace(text, '{SPACED}', ' ', 'g'), 1, 200), chr(10) order by rank)) previews_sha256 from t where rank <= {K} group by query_id""",
    "mode_comparison": f"with {RANKED}, {MAPPED}, "
    + ", ".join(_metrics(m, k, f"{m}{k}") for m in ("lexical", "bm25") for k in (1, 3, 5, 10))
    + " "
    + " union all ".join(f"select '{m}' mode, {k} k, {SUMMARY} from {m}{k}" for m in ("lexical", "bm25") for k in (1, 3, 5, 10)),
    "cutoff_metrics": f"""{FULL}, e as (select k, query_id, min(rank) f, count(*) n from flags, (select unnest([1, 3, 5, 10]) k) where relevant = 1 and rank <= k group by k, query_id)
      select k, count(*) hits, round(sum(1.0 / f), 6) reciprocal, sum(n)::bigint recalled from e group by k""",
    "failure_cases": f"with {RANKED}, {MAPPED}{FAILED} select query_id, failure from fc",
    "failure_breakdown": f"with {RANKED}, {MAPPED}{FAILED} select failure, count(*) n from fc group by failure",
    "evidence_coverage": f"""with {RANKED}, {MAPPED}, r as (select span_id, greatest(start_char, s) a, least(end_char, e) b from spans join (select query_id, document_id, start_char, end_char from bm25 join chunks using (chunk_id))
        using (query_id, document_id) where greatest(start_char, s) < least(end_char, e)
      ), p as (select span_id, count(distinct x) n from (select span_id, unnest(range(a, b)) x from r) group by span_id) select span_id, round(coalesce(n, 0) / (e - s)::double, 6) coverage from spans left join p using (span_id)""",
    "duplicate_context": f"""{WITH_TEXT}, f as (select query_id, rank, trim(regexp_replace(lower(text), '{SPACED}', ' ', 'g')) x from t)
      , s as (select distinct query_id, rank, substr(x, i, 20) g from (select *, unnest(range(1, greatest(length(x) - 19, 1) + 1)) i from f))
      select query_id, round((count(*) - count(distinct g)) / count(*)::double, 6) duplicate_ratio from s group by query_id""",
    "ngram_coverage": f"""{WITH_TEXT}, gq as (select distinct query_id, w[i:i + 2] g from (select query_id, w, unnest(range(1, len(w) - 1)) i from (select query_id, regexp_extract_all(lower(query), '{W}') w from cases)))
      , gt as (select distinct query_id, w[i:i + 2] g from (select query_id, w, unnest(range(1, len(w) - 1)) i from (select query_id, regexp_extract_all(lower(text), '{W}') w from t where rank <= 5)))
      select query_id, count(gt.g) n_held, count(*) n_grams, round(count(gt.g) / count(*)::double, 6) coverage from gq left join gt using (query_id, g) group by query_id""",
    "latency_percentiles": """select event_type, count(value) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, max(value) maximum from events group by event_type""",
    "metric_spread": """with d as (select event_type, ts::date "day", round(avg(value), 9) v from events group by all)
      select event_type, round(min(v), 6) least, round(max(v), 6) greatest, round(max(v) - min(v), 6) spread from d group by event_type""",
    "fragment_evidence": f"""{SCORED}, gg as (select query_id, unnest(list_distinct(list_transform(range(1, len(q0) - 1), lambda k: q0[k] || ' ' || q0[k + 1] || ' ' || q0[k + 2]))) g from q1)
      , ft as (select query_id, regexp_extract_all({FOLD.format('text')}, '{W}') w from fr), ra as (select distinct query_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) g from ft)
      , oa as (select distinct query_id, unnest(w3) g from be), sa as (select distinct query_id, unnest(w3) g from bq)
      select query_id, count(*) n_gold, count(ra.g) n_reachable, count(oa.g) n_oracle, count(sa.g) n_selected, round(count(sa.g) / count(*)::double, 6) coverage,
        case when count(oa.g) > 0 then round(count(sa.g) / count(oa.g)::double, 6) end efficiency
      from gg left join ra using (query_id, g) left join oa using (query_id, g) left join sa using (query_id, g) group by query_id""",
    "stable_rankings": f"with {RANKED} select query_id, (case when query_id % 3 = 0 and max(rank) = {LIMIT} then 2 else 1 end)::bigint n_rankings from bm25 group by query_id",
    "unfinished_trials": """select "mode", k::int k, r::int repetition from (select distinct event_type "mode" from events), (select unnest([1, 2, 5, 11]) k), (select unnest(range(4)) r)
      where not exists (select 1 from events where event_type = "mode" and user_id % 10 = k and user_id % 4 = r)""",
    "input_checks": f"""with {DOCS}, d as (select count(*) = count(distinct document_id) ids, count(*) filter (where t = '') = 0 texts from docs), b as (select count(*) >= 10 cases, count(*) = count(distinct text) hashes, min(length(text)) > 10000 sizes from benchmark)
      select *, ids and texts and cases and hashes and sizes all_passed from d, b""",
    "farthest_documents": """with recursive p as (select source, lang, doc_id id, length(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'))::double x from documents)
      , f as (select source, lang, [min_by(id, id)] c, [min_by(x, id)] xs, 1 n from p group by source, lang
        union all select f.source, f.lang, list_append(any_value(c), max_by(id, (d, -id))), list_append(any_value(xs), max_by(x, (d, -id))), n + 1
        from (select f.source, f.lang, c, xs, n, id, x, list_min(list_transform(xs, lambda y: abs(y - x))) d from f join p on f.source is not distinct from p.source and f.lang is not distinct from p.lang
          where n < 4 and not list_contains(c, id)) f group by f.source, f.lang, n)
      , l as (select source, lang, arg_max(c, n) c from f group by source, lang)
      select source, lang, unnest(c) id, unnest(range(len(c)))::int place from l""",
    "farthest_points": """with recursive p as (select item_id, length(text)::double x from benchmark), f as (select [min_by(item_id, item_id)] c, [min_by(x, item_id)] xs, 1 n from p
        union all select list_append(c, (nx).item_id), list_append(xs, (nx).x), n + 1 from (select c, xs, n, (select max_by({'item_id': item_id, 'x': x}, (list_min(list_transform(xs, lambda y: abs(y - x))), -item_id)) from p where not list_contains(c, item_id)) nx from f where n < 5) where nx is not null)
      select unnest(c) item_id, unnest(range(len(c)))::int place from f where n = (select max(n) from f)""",
    "transitions": f"""with {RANKED}, {MAPPED}, {_metrics("lexical", K, "a")}, {_metrics("bm25", K, "b")}
      select case when a.n_relevant > 0 and b.n_relevant > 0 then 'retained' when a.n_relevant > 0 then 'lost' when b.n_relevant > 0 then 'gained' else 'missed' end transition, count(*) n
      from a join b using (query_id) group by 1""",
    "screen_transitions": """with t as (select user_id, event_type, max(value) > 50 hit from events group by all), n as (select user_id, count(*) filter (where hit) h, count(*) n from t group by user_id)
      , c as (select user_id, avg(value) > 60 hit from events group by user_id)
      select user_id query_id, h n_hits, n n_trials, hit, case when user_id % 10 = 0 or (h > 0 and h < n) then 'boundary' when h > 0 then case when hit then 'retained' else 'lost' end when hit then 'gained' else 'unchanged_miss' end transition
      from n join c using (user_id)""",
    "heldout_overlap": f"""with {DOCS} select document_id from docs where document_id in (select doc_id from labels) and t in (select t from docs where document_id not in (select doc_id from labels))""",
    "review_merge": """select item_id query_id, sha256(case when item_id % 6 = 3 then upper(text) else text end) query_sha256, case when item_id % 3 = 0 then 'better' else substr(text, 1, 10) end answer, item_id % 3 = 0 changed from benchmark""",
    "rule_violations": """with b as (select event_id, 'low' c, not coalesce(value < 60, false) x from events union all select event_id, 'typed', event_type is null from events union all select event_id, 'even', event_id % 2 <> 0 from events)
      select c condition, count(*) filter (where x) n, coalesce(array_to_string(list_sort(list(event_id) filter (where x))[1:5], ','), '') examples from b group by c""",
    "generated_cases": """with w as (select item_id span_id, string_split(text, ' ')[1:4] w from benchmark where item_id % 5 <> 0 and item_id % 7 <> 0)
      select 'synthetic-span-' || lpad((row_number() over (order by span_id))::varchar, 6, '0') case_id, span_id, 'What of ' || array_to_string(w, ' ') || '?' query, array_to_string(w[1:2], ' ') answer from w""",
    "screen_gates": """with r as (select event_id % 2 = 0 sem, event_id % 4 < 2 nar, user_id, count(*) filter (where event_id % 3 > 0 and value > 50) bh, count(*) filter (where event_id % 3 > 0) nt, count(*) filter (where event_id % 3 = 0 and value > 50) c,
        sum(event_id % 100) filter (where event_id % 3 = 0) ct, sum(event_id % 100) filter (where event_id % 3 = 1) bt from events group by all)
      , g as (select count(*) filter (where sem and nar and user_id % 3 = 0 and c = 0) l, count(*) filter (where c = 0 and user_id % 10 < 3 and user_id % 5 <> 0) m, count(*) filter (where sem and user_id % 3 > 0 and bh = 0 and c > 0 and nar) a,
        count(*) filter (where sem and user_id % 3 > 0 and bh = 0 and c > 0 and not nar) b, sum((c > 0)::int - (2 * bh > nt)::int) filter (where not sem and nar) h, sum(ct) filter (where not sem and nar) / sum(bt) filter (where not sem and nar) t from r)
      select gate, round(v, 6) "value", p passed from (select 'stable_losses' gate, l::double v, l = 0 p from g union all select 'new_missed_sources', m, m = 0 from g union all select 'gains', a, a >= 1 or b >= 1 from g
        union all select 'wide_gains', b, a >= 1 or b >= 1 from g union all select 'hybrid_change', h, h >= 0 from g union all select 'token_ratio', t, t <= 1.1 from g)""",
    "cache_report": f"""with {CHUNKS}, h as (select sha256(text) h, document_id from chunks), k as (select distinct h from h where document_id % 2 = 0)
      select count(*) filter (where h in (select h from k)) hits, count(*) filter (where h not in (select h from k)) misses, count(distinct h) filter (where h not in (select h from k)) new_texts from h""",
    "case_files": "select 'case-' || lpad(item_id::varchar, 5, '0') id, sha256(text) query_sha256, 'src/' || item_id path, length(text)::varchar size from benchmark",
    "trace_files": "with t as (select 'ask-' || conv_id trace_id, 'ask' operation, count(*)::varchar turns from conversations group by conv_id) select * from t union all select * from t where trace_id = 'ask-1'",
    "run_files": f"""with {RANKED}, {CASE_RESULTS} select rank is not null passed, count(*) n, (select count(*) from cr where rank is null) n_failures, (select (4 + 23 + 3 + count(*) filter (where rank is null) // greatest(count(*) filter (where rank is null), 1))::bigint from cr) n_lines from cr group by 1""",
    "normal_chunks": "select conv_id || '-' || turn chunk_id, 'unknown' document_id, turn::int chunk_index, 'text/plain' media_type, 'simple' strategy, sha256(text) text_sha256 from conversations",
    "redacted_metadata": """select doc_id, '{"id":' || doc_id || ',"inner":{"n":' || doc_id % 5 || '},"list":[{"m":' || doc_id % 3 || '}]}' metadata from documents""",
    "session_append": """with t as (select conv_id, turn, text from conversations), n as (select conv_id, count(*) n, max(turn) m, count(*) filter (where turn < 2) k from t group by conv_id)
      select n.conv_id session_id, n + k n, (m + k)::int last, sha256(text) last_sha256 from n join t on t.conv_id = n.conv_id and t.turn = (select max(turn) from t u where u.conv_id = n.conv_id and turn < 2)""",
    "session_changes": """select conv_id session_id, case when conv_id = 1 then 'A new title' else min_by(substr(text, 1, 40), turn) filter (where role = 'user') end title, conv_id = 1 pinned, conv_id = 2 starred
      from conversations where conv_id <> 3 group by conv_id""",
    "session_filters": """with s as (select conv_id, bool_or(turn % 5 = 4) f, bool_or(role = 'assistant') a from conversations group by conv_id)
      select 'recent' "filter", count(*) n from s union all select 'pinned', count(*) filter (where conv_id % 10 = 0) from s union all select 'starred', count(*) filter (where conv_id % 7 = 0) from s
      union all select 'failed', count(*) filter (where f) from s union all select 'has-sources', count(*) filter (where a) from s""",
    "search_traces": f"""with {RANKED} select 'search-' || query_id trace_id, 'search' operation, 'success' status, count(*)::varchar n_results, count(distinct chunk_id)::varchar n_chunks, round(max(score), 4) best_score from bm25 group by query_id""",
    "session_summary": """select conv_id session_id, count(*) n_turns, count(*) filter (where role = 'user') n_user, sum(length(text))::bigint n_chars,
      min_by(substr(text, 1, 40), turn) filter (where role = 'user') title, count(*) filter (where turn % 5 = 4) n_failed, (count(distinct length(text) % 7) filter (where role = 'assistant'))::int n_sources from conversations group by conv_id""",
    "session_branch": "select conv_id || '-branch-1' session_id, turn, role, sha256(text) text_sha256 from conversations where turn <= 1",
    "session_search": """select conv_id session_id, count(*) filter (where contains(lower(text), 'notes/3') or role = 'assistant' and length(text) % 7 = 3) n_matches from conversations group by conv_id
      having n_matches > 0 or contains(lower(min_by(substr(text, 1, 40), turn) filter (where role = 'user')), 'notes/3')""",
    "session_export": """select conv_id session_id, sha256(string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn)) markdown_sha256 from conversations group by conv_id""",
    "trace_list": "select event_id trace_id, event_type operation, ts started_at from events order by ts desc, event_id desc limit 20",
    "schema_migrate": "select case when event_id % 3 > 0 then event_id % 3 end::int before, 2 schema_version, count(*) n from events group by 1",
}

"""Registered queries over stored indexes, with their DuckDB counterparts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import gates, leakage, prepared, retrieval, selection, vector_index
from plinth.plans import search_plans, trials
from plinth.plans.search_plans import FOLD, LIMIT, MAPPED, RANKED, SCORED, W, cases_of, counted_of, gold_of, results_of, shown, spans_of, with_chunks
from plinth.plans.text_plans import CHUNKS, DOCS, chunks_of
from plinth.sources import generations, providers
from plinth.sources.embedding_cache import EmbeddingCache
from plinth.sources.shared import new_folder, sent, stored
from plinth.sources.tables import documents, table, vectors


def prepared_bm25(spark, sf_dir):
    """The BM25 results of a stored index, whose searches read no text."""
    index = prepared.Index(spark, prepared.write(chunks_of(spark, sf_dir)))
    return shown(index.bm25(cases_of(spark, sf_dir), LIMIT))


def prepared_lexical(spark, sf_dir):
    index = prepared.Index(spark, prepared.write(chunks_of(spark, sf_dir)))
    return shown(index.lexical(cases_of(spark, sf_dir), LIMIT))


def prepared_stats(spark, sf_dir):
    """The statistics that an index keeps of its chunks."""
    return prepared.Index(spark, prepared.write(chunks_of(spark, sf_dir))).statistics().withColumn("avg_length", F.round("avg_length", 6))


def vector_index_search(spark, sf_dir):
    """Every twentieth vector against all, by an index that rules groups out."""
    rows = vectors(spark, sf_dir)
    index = vector_index.VectorIndex(spark, vector_index.write(rows.select(F.col("vec_id").alias("chunk_id"), "embedding")))
    return shown(index.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), LIMIT))


def both_modes(spark, sf_dir) -> DataFrame:
    """BM25's and the lexical results with their text, by mode."""
    counted = counted_of(spark, sf_dir)
    parts = [results_of(spark, sf_dir, mode, counted=counted).withColumn("mode", F.lit(mode)) for mode in ("bm25", "lexical")]
    return stored(with_chunks(spark, sf_dir, parts[0].unionByName(parts[1])).select("mode", "query_id", "rank", "chunk_id", "document_id", "text"), "modes")


def replay_gates(spark, sf_dir):
    """Whether a prefix of 1,600 tokens of the ten results may stand for all."""
    rows = selection.replay(both_modes(spark, sf_dir), gold_of(spark, sf_dir), 1600, "mode")
    return _shown_gates(gates.replay_gates(rows, "bm25", "lexical", 1600, (1, 0), 0.7))


def direction_gates(spark, sf_dir):
    """Whether ten results cut to 1,600 tokens may replace five whole ones."""
    ranked, spans = both_modes(spark, sf_dir), stored(spans_of(spark, sf_dir), "spans")
    gold = stored(gold_of(spark, sf_dir, spans), "gold")
    rows = selection.replay(ranked, gold, 1600, "mode").withColumnRenamed("parent_hit", "candidate_hit")
    narrow = selection.replay(ranked.where("rank <= 5"), gold, 1600, "mode").select("mode", "query_id", "parent_hit", F.col("chars_all").alias("parent_chars"))
    near = ranked.join(spans.select("query_id", "document_id").distinct(), ["query_id", "document_id"]).groupBy("mode", "query_id").agg(F.min("rank").alias("first"))
    rows = rows.join(narrow, ["mode", "query_id"]).join(near, ["mode", "query_id"], "left")
    missed = {"missed": F.col("first").isNull(), "parent_missed": F.coalesce(F.col("first") > 5, F.lit(True)), "within": F.col("chars_kept") <= 4 * 1600}
    return _shown_gates(gates.direction_gates(rows.withColumns(missed), "bm25", "lexical", (0.0, 0.05), (1, 3), 1.5))


def fragment_gates(spark, sf_dir):
    """Whether fragments of BM25's ten results may stand for them."""
    found = stored(with_chunks(spark, sf_dir, results_of(spark, sf_dir, "bm25")), "found")
    fragments = stored(search_plans.best_fragments(spark, sf_dir, found), "fragments")
    held = stored(search_plans.evidence_of_fragments(spark, sf_dir, found), "held")
    whole = found.select("query_id", "chunk_id", "text")
    lost = selection.untraceable(fragments, whole.select("chunk_id", "text").distinct()).groupBy("query_id").agg(F.count("*").alias("n_lost"))
    size = F.length("header") + F.length("window_text") + 1
    own = fragments.groupBy("query_id").agg(F.count("*").alias("n_fragments"), (F.sum(size) + 2 * (F.count("*") - 1)).alias("chars"))
    parents = whole.groupBy("query_id").agg(F.count("*").alias("n_results"), F.sum(F.length("text")).alias("parent_chars"))
    rows = held.join(own, "query_id").join(parents, "query_id").join(lost, "query_id", "left").fillna(0, ["n_lost"])
    flags = {"parent_hit": F.col("n_reachable") > 0, "scorable": F.col("n_gold") > 0, "oracle_hit": F.col("n_oracle") > 0, "hit": F.col("n_selected") > 0}
    more = {"mode": F.lit("bm25"), "budget": F.lit(3072), "n_unmapped": F.lit(0), "held": F.try_divide("n_selected", "n_reachable")}
    return _shown_gates(gates.fragment_gates(rows.withColumns(flags | more), {"bm25": 2}, "bm25", unreachable=5, ratio=0.5, coverage=(0.5, 0.3, 0.8)))


def _shown_gates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.round("value", 6))


def heldout_leakage(spark, sf_dir):
    """What the unlabelled documents hold of the labelled ones: whole texts, and near ones by five-word shingles."""
    docs = documents(spark, sf_dir).select(F.col("document_id").alias("id"), "text")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("held")).distinct()
    found = leakage.marked_leakage(docs.join(sent(known), "id", "left").fillna(False, ["held"]))
    return found.withColumn("closest", F.round("closest", 6))


def trial_matrix(spark, sf_dir):
    """Results of two modes at two limits, kept, and how many cells a second run had to make: none. Then one is deleted, and a third run
    makes that one alone; its results and the kept ones are counted. A cell without results counts as none."""
    cases, chunks = cases_of(spark, sf_dir), chunks_of(spark, sf_dir)
    search = {"lexical": retrieval.lexical_search, "bm25": retrieval.bm25_search}
    counted = functools.cache(lambda: retrieval.count_for(chunks, cases))  # once, by the first cell that runs

    def run(cell: dict) -> DataFrame:
        found = search[cell["mode"]](chunks, cases, cell["k"], counted=counted())
        return found.select(F.concat_ws(":", F.format_string("%012d", "query_id"), F.format_string("%06d", "rank")).alias("key"), "query_id", "rank", "chunk_id")

    inputs = {"cases": trials.digest_of(cases, "query_id", "query"), "documents": trials.digest_of(documents(spark, sf_dir), "document_id", "text")}
    matrix = trials.TrialMatrix(spark, new_folder(spark, "trials"), inputs, "key", run)
    cells = [{"mode": m, "k": k} for m in search for k in (1, 5)]
    matrix.complete(cells)
    first = len(matrix.ran)
    matrix.complete(cells)
    again = len(matrix.ran)
    generations.forget(matrix.name(cells[0]))
    rows = matrix.complete(cells)
    if matrix.ran != cells[:1]:
        raise ValueError(f"one cell was deleted, and these were run: {matrix.ran}")
    found = rows.groupBy("mode", "k").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("chunk_id").alias("n_chunks"))
    every = spark.createDataFrame([(c["mode"], c["k"]) for c in cells], "mode string, k int")
    found = every.join(found, ["mode", "k"], "left").fillna(0, ["n", "n_queries", "n_chunks"])
    return found.withColumns({"ran_first": F.lit(first), "ran_again": F.lit(again)})


def cached_embeddings(spark, sf_dir):
    """Vectors of chunks by way of a cache: of every other document first, then of all, then of all again, compacted in between."""
    chunks, provider = chunks_of(spark, sf_dir), providers.hashing_provider()
    cache = EmbeddingCache(spark, new_folder(spark, "embeddings"), {"provider": "hashing", "dimensions": "64"})
    cache.embed(chunks.where("document_id % 2 = 0"), provider)
    first = cache.asked
    cache.embed(chunks, provider)
    second = cache.asked
    cache.compact()
    rows = cache.embed(chunks, provider)
    sums = rows.agg(F.count("*").alias("n"), F.count_distinct("text_hash").alias("n_texts"), F.count_if(F.size("embedding") == 64).alias("n_whole"))
    return sums.withColumns({"asked_first": F.lit(first), "asked_then": F.lit(second), "asked_last": F.lit(cache.asked)})


QUERIES = {f.__name__: f for f in (prepared_bm25, prepared_lexical, prepared_stats, vector_index_search, replay_gates, direction_gates, fragment_gates, heldout_leakage, trial_matrix, cached_embeddings)}
MODES = f"""with {RANKED}, {MAPPED}, r0 as (select 'bm25' "mode", * from bm25 union all select 'lexical', * from lexical)
  , r as (select "mode", query_id, rank, document_id, length(text) n, g.chunk_id is not null g, sum(length(text)) over (partition by "mode", query_id order by rank) <= 6400 k
    from r0 join chunks using (chunk_id) left join gold g using (query_id, chunk_id))
  , c as (select "mode", query_id, "mode" || ':' || query_id key, bool_or(g) p, bool_or(g and k) h, count(*) filter (where k) nk, coalesce(max(rank) filter (where k), 0) lk, coalesce(sum(n) filter (where k), 0) ck, sum(n) ca,
      bool_or(g and rank <= 5) p5, sum(n) filter (where rank <= 5) c5 from r group by "mode", query_id)"""


def _count_gate(name: str, condition: str, most: float, table: str = "c") -> str:
    first = f"array_to_string(list_sort(coalesce(list(key) filter (where {condition}), []))[1:20], ',')"
    return f"select '{name}' gate, (count(*) filter (where {condition}))::double \"value\", {most}::double \"limit\", count(*) filter (where {condition}) <= {most} passed, {first} \"cases\" from {table}"


def _sum_gate(name: str, value: str, side: str, limit: float, table: str = "c") -> str:
    return f"select '{name}', round({value}, 6), {limit}::double, coalesce({value} {side} {limit}, false), '' from {table}"


def _mean(column: str, mode: str) -> str:
    return f"avg({column}) filter (where \"mode\" = '{mode}')"


PACKED = f"""{SCORED}, gg as (select query_id, unnest(list_distinct(list_transform(range(1, len(q0) - 1), lambda k: q0[k] || ' ' || q0[k + 1] || ' ' || q0[k + 2]))) g from q1)
  , ft as (select query_id, regexp_extract_all({FOLD.format('text')}, '{W}') w from fr), ra as (select distinct query_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) g from ft)
  , oa as (select distinct query_id, unnest(w3) g from be), sa as (select distinct query_id, unnest(w3) g from bq)
  , ev as (select query_id, count(*) n_gold, count(ra.g) nr, count(oa.g) no, count(sa.g) ns from gg left join ra using (query_id, g) left join oa using (query_id, g) left join sa using (query_id, g) group by query_id)
  , ow as (select query_id, count(*) nf, sum(length(header) + length(wt) + 1) + 2 * (count(*) - 1) chars from bq group by query_id), wh as (select query_id, count(*) n, sum(length(text)) pc from fr group by query_id)
  , c as (select *, 'bm25' "mode", 'bm25:' || query_id key from ev join ow using (query_id) join wh using (query_id)) """
SQL = {
    "heldout_leakage": f"""with {DOCS}, w as (select document_id id, t, regexp_extract_all(lower(t), '{W}') w, document_id in (select doc_id from labels) held from docs)
      , s as (select distinct id, held, array_to_string(w[i:i + 4], ' ') g from (select id, held, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0))
      , z as (select id, count(*) n from s group by id), p as (select a.id, b.id other, count(*) c from s a join s b using (g) where a.held and not b.held group by 1, 2)
      , j as (select p.id, other, c / (x.n + y.n - c)::double r from p join z x on x.id = p.id join z y on y.id = other)
      , n as (select id, count(*) n_near, round(max(r), 6) closest from j where r >= 0.8::double - 1e-12 group by id), e as (select t, count(*) n from w where not held group by t)
      select w.id, false same_id, coalesce(e.n, 0) n_equal, coalesce(n_near, 0) n_near, closest from w left join e using (t) left join n on n.id = w.id where held""",
    "fragment_gates": PACKED
    + " union all ".join(
        (
            _count_gate("bm25_fragment_hits_retained", "nr > 0 and n_gold > 0 and ns = 0", 2),
            _count_gate("oracle_evidence_reachable", "nr > 0 and no = 0", 5),
            _count_gate("all_candidates_represented", "nf <> n", 0),
            _count_gate("fragments_traceable", "false", 0),
            _count_gate("contexts_within_budget", "chars > 3072", 0),
            _count_gate("fragments_mapped", "false", 0),
            _count_gate("case_coverage", "coalesce(ns / nullif(nr, 0)::double, 0) < 0.3", 0),
            _sum_gate("bm25_context_tokens", "avg(chars) / avg(pc)", "<=", 0.5),
            _sum_gate("selector_isolated", "1.0::double", ">=", 1.0, "(select 1)"),
            _sum_gate("bm25_coverage", "avg(ns / nullif(nr, 0)::double)", ">=", 0.5),
            _sum_gate("bm25_efficiency", "avg(round(ns / nullif(no, 0)::double, 6))", ">=", 0.8),
            _sum_gate("bm25_parent_hits", "sum((nr > 0)::int)", ">=", 1.0),
        )
    ),
    "replay_gates": MODES
    + " "
    + " union all ".join(
        (
            _count_gate("bm25_hits_retained", "\"mode\" = 'bm25' and p and not h", 1),
            _count_gate("lexical_hits_retained", "\"mode\" = 'lexical' and p and not h", 0),
            _count_gate("contexts_nonempty", "nk < 1", 0),
            _count_gate("contexts_within_budget", "ck > 6400", 0),
            _count_gate("ranked_prefix_kept", "nk <> lk", 0),
            _sum_gate("lexical_context_tokens", f"{_mean('ck', 'lexical')} / {_mean('ca', 'lexical')}", "<=", 0.7),
        )
    ),
    "direction_gates": MODES
    + """, near as (select r."mode", r.query_id, min(rank) f from r join (select distinct query_id, document_id from spans) using (query_id, document_id) group by 1, 2)
      , d as (select c.*, f is null missed, coalesce(f > 5, true) parent_missed from c left join near using ("mode", query_id)) """
    + " union all ".join(
        (
            _count_gate("bm25_context_hits_retained", "\"mode\" = 'bm25' and p and not h", 1, "d"),
            _count_gate("lexical_context_hits_retained", "\"mode\" = 'lexical' and p and not h", 3, "d"),
            _count_gate("no_new_missed_source", "missed and not parent_missed", 0, "d"),
            _count_gate("invariants", "ck > 6400 or nk <> lk", 0, "d"),
            *(_sum_gate(f"{m}_hit_direction", f"{_mean('p::int', m)} - {_mean('p5::int', m)}", ">=", n, "d") for m, n in (("bm25", 0.0), ("lexical", 0.05))),
            _sum_gate("lexical_context_tokens", f"{_mean('ck', 'lexical')} / {_mean('c5', 'lexical')}", "<=", 1.5, "d"),
        )
    ),
    "prepared_bm25": search_plans.SQL["bm25_search"],
    "prepared_lexical": search_plans.SQL["lexical_search"],
    "trial_matrix": f"with {RANKED} "
    + " union all ".join(f"select '{m}' \"mode\", {k} k, count(*) n, count(distinct query_id) n_queries, count(distinct chunk_id) n_chunks, 4 ran_first, 0 ran_again from {m} where rank <= {k}" for m in ("lexical", "bm25") for k in (1, 5)),
    "cached_embeddings": f"""with {CHUNKS}, h as (select sha256(text) h, document_id % 2 = 0 even from chunks), d as (select h, bool_or(even) even from h group by h)
      select (select count(*) from h) n, count(*) n_texts, (select count(*) from h) n_whole, count(*) filter (where even) asked_first, count(*) filter (where not even) asked_then, 0::bigint asked_last from d""",
    "vector_index_search": search_plans.SQL["semantic_search"],
    "prepared_stats": search_plans.SQL["corpus_stats"],
}

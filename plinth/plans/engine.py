"""A thin session over the operators: search in a mode, ask, and evaluate; every step is a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import strip
from plinth.operators import evaluate, prepared, retrieval, selection
from plinth.operators.prepared import Index
from plinth.sources.shared import stored

MODES = ("lexical", "bm25", "semantic", "hybrid")
#: Snapshots whose stored indexes an engine keeps in mind.
KEPT = 16
Step = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """Ranks chunks (chunk_id, text, ...) for queries (query_id, query). Only one snapshot's chunks are kept at a time.

    ``index`` (chunk_id, embedding), or what makes it of the chunks, and ``embed`` (queries -> (query_id, embedding)) are needed for the semantic and hybrid modes.
    ``rerank`` and ``select`` may replace what follows the candidates; ``select`` defaults to the best of each query.
    """

    chunks: DataFrame
    index: DataFrame | Step | None = None
    embed: Step | None = None
    rerank: Step | None = None
    select: Step | None = None
    statistics: dict[str, int] = field(default_factory=lambda: {"loads": 0, "hits": 0, "invalidations": 0})
    prepared: Index | None = None
    _kept: dict[str, DataFrame] = field(default_factory=dict)
    _indexes: dict[str, Index] = field(default_factory=dict)

    def keep(self, snapshot_id: str) -> Engine:
        """Persists the chunks under a snapshot's name, once; another snapshot's are given up."""
        for name in [n for n in self._kept if n != snapshot_id]:
            self._kept.pop(name).unpersist()
            self.statistics["invalidations"] += 1
        if snapshot_id in self._kept:
            self.statistics["hits"] += 1
        else:
            self._kept[snapshot_id] = self.chunks.persist()
            self.statistics["loads"] += 1
        self.chunks = self._kept[snapshot_id]
        return self

    def prepare(self, snapshot_id: str, folder: str | None = None) -> Engine:
        """Stores an inverted index of the chunks, with their tokens, counts and statistics, under a snapshot's name, once; lexical and BM25
        searches then read it instead of the texts. The last KEPT snapshots' indexes stay known, the one unused for longest is given up."""
        if snapshot_id in self._indexes:
            self.statistics["hits"] += 1
            self.prepared = self._indexes[snapshot_id] = self._indexes.pop(snapshot_id)
            return self
        self.prepared = self._indexes[snapshot_id] = Index(self.chunks.sparkSession, prepared.write(self.chunks, folder))
        self.statistics["loads"] += 1
        while len(self._indexes) > KEPT:
            self._indexes.pop(next(iter(self._indexes)))
            self.statistics["invalidations"] += 1
        return self

    def candidates(self, queries: DataFrame, mode: str, limit: int, counted: retrieval.Counted | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        asked = self._asked(queries)
        if mode in ("lexical", "bm25") and self.prepared is not None:
            return getattr(self.prepared, mode)(asked, limit)
        if mode in ("lexical", "bm25"):
            search = retrieval.lexical_search if mode == "lexical" else retrieval.bm25_search
            return search(self.chunks, asked, limit, counted=counted)
        if self.index is None or self.embed is None:
            raise ValueError(f"mode {mode} needs an index and an embedding of queries")
        if mode == "semantic":
            return retrieval.semantic_search(retrieval.known_vectors(self.chunks, self.index), self.embed(asked), limit)
        return retrieval.hybrid_search(self.chunks, self.index, asked, self.embed(asked), limit, counted)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.coalesce(strip(F.col("query")), F.lit("")) != "")

    def search(self, queries: DataFrame, mode: str = "lexical", limit: int = 10, counted: retrieval.Counted | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score; an empty query has no results."""
        found = retrieval.deduplicate(self.candidates(queries, mode, limit, counted).select("query_id", "rank", "chunk_id", "score"))
        found = self.rerank(found) if self.rerank else found
        return self.select(found) if self.select else found.where(F.col("rank") <= limit)

    def stages(self, queries: DataFrame, mode: str = "lexical", limit: int = 10, budget_tokens: int = 1024) -> DataFrame:
        """The stages of a search in order: stage, rows in, rows out, milliseconds; rerank and select are skipped where nothing is set.

        Every stage is written once, so that its time and rows are its own. An empty query takes no part in what follows.
        """
        rows, steps = [], []

        def run(name: str, given: int, step: Callable[[], DataFrame] | None, passed: DataFrame) -> DataFrame:
            began = time.perf_counter()
            out = passed if step is None else stored(step(), name)
            n = out.count()
            rows.append((len(rows), name, "skipped" if step is None else "done", given, n, round(1000 * (time.perf_counter() - began), 3)))
            steps.append(n)
            return out

        asked = run("normalize", queries.count(), lambda: self._asked(queries), queries)
        found = run("candidates", steps[-1], lambda: self.candidates(asked, mode, limit).select("query_id", "rank", "chunk_id", "score"), asked)
        unique = run("deduplicate", steps[-1], lambda: retrieval.deduplicate(found), found)
        ranked = run("rerank", steps[-1], (lambda: self.rerank(unique)) if self.rerank else None, unique)
        kept = run("select", steps[-1], lambda: self.select(ranked) if self.select else ranked.where(F.col("rank") <= limit), ranked)
        run("budget", steps[-1], lambda: selection.budget_prefix(kept.join(self.chunks, "chunk_id"), budget_tokens), kept)
        return queries.sparkSession.createDataFrame(rows, "stage_index int, stage string, status string, n_in long, n_out long, latency_ms double")

    def context(self, queries: DataFrame, mode: str = "lexical", limit: int = 5, most: int = 4000) -> DataFrame:
        """The packed results of each query, with their text."""
        return selection.context_pack(self.search(queries, mode, limit).join(self.chunks, "chunk_id"), most)

    def ask(self, queries: DataFrame, generate: Step | None = None, mode: str = "lexical", limit: int = 5, most: int = 4000) -> DataFrame:
        """query_id, prompt, status and answer; without ``generate`` (prompts -> (query_id, answer)) the status is not_configured."""
        prompts = queries.select("query_id").join(selection.prompt(self.context(queries, mode, limit, most)), "query_id", "left")
        if generate is None:
            return prompts.withColumns({"status": F.lit("not_configured"), "answer": F.lit(None).cast("string")})
        answered = prompts.join(generate(prompts.where("prompt is not null")), "query_id", "left")
        status = F.when(F.col("prompt").isNull(), "skipped").when(F.col("answer").isNull(), "failed").otherwise("success")
        return answered.withColumn("status", status).select("query_id", "prompt", "status", "answer")

    def compare(self, cases: DataFrame, gold: DataFrame, modes: list[str], limits: list[int], fail_fast: bool = True) -> DataFrame:
        """Metrics of every mode at every limit; modes that count tokens share the pass over the texts. A mode that can't run is an error, or
        a row with its message where ``fail_fast`` is off."""
        out, failed = None, []
        hybrid = {"hybrid"} if self.index is not None and self.embed is not None else set()
        counting = {*modes} & ({"lexical", "bm25"} if self.prepared is None else set()) | {*modes} & hybrid
        counted = retrieval.count_for(self.chunks, self._asked(cases)) if len(counting) > 1 else None
        for mode in dict.fromkeys(modes):
            try:
                ranked = stored(self.search(cases, mode, max(limits), counted), "results")
            except ValueError as wrong:
                if fail_fast:
                    raise
                failed += [(mode, k, str(wrong)) for k in dict.fromkeys(limits)]
                continue
            for k in dict.fromkeys(limits):
                part = evaluate.case_metrics(cases, ranked, gold, k).withColumns({"mode": F.lit(mode), "k": F.lit(k)})
                out = part if out is None else out.unionByName(part)
        found = None if out is None else evaluate.summary(out, "mode", "k").withColumn("error", F.lit(None).cast("string"))
        if not failed:
            return found
        rows = cases.sparkSession.createDataFrame(failed, "mode string, k int, error string")
        return rows if found is None else found.unionByName(rows, allowMissingColumns=True)


def listed(text: str) -> list[str]:
    """The parts of a comma-separated list, each once, in order."""
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))

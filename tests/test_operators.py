"""Operators on small inputs with known results."""

import math
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import chunking, evaluate, evidence, history, parse, represent, retrieval, selection
from plinth.sources import providers
from tests.conftest import ROOT

CHUNK = "chunk_id string, text string"
RANKED = "query_id long, rank int, chunk_id string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "document_id long, source_path string, text string")


def query(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, query string")


def ids(rows):
    return [r["chunk_id"] for r in rows.orderBy("rank").collect()]


def test_entry_imports_without_llm():
    code = (
        "import sys; sys.modules['plinth.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_tokens(spark):
    got = spark.range(1).select(T.tokens(F.lit("Agent-memory, RAG_101! Ünïcode"))).first()[0]
    assert got == ["agent", "memory", "rag_101", "ünïcode"]


def test_bm25(spark):
    chunks = spark.createDataFrame([("a::chunk-0000", "agent agent memory"), ("b::chunk-0000", "agent planning"), ("c::chunk-0000", "retrieval basics")], CHUNK)
    assert ids(retrieval.bm25_search(chunks, query(spark, "agent memory"))) == ["a::chunk-0000", "b::chunk-0000"]
    score = {r["chunk_id"]: r["score"] for r in retrieval.bm25_search(chunks, query(spark, "agent retrieval")).collect()}
    assert score["c::chunk-0000"] > score["b::chunk-0000"]
    once, twice = (retrieval.bm25_search(chunks, query(spark, q)).first()["score"] for q in ("memory", "memory memory"))
    assert math.isclose(twice, 2 * once)
    ties = spark.createDataFrame([("b", "agent memory"), ("a", "agent memory")], CHUNK)
    assert ids(retrieval.bm25_search(ties, query(spark, "agent"))) == ["a", "b"]
    assert ids(retrieval.bm25_search(chunks, query(spark, "  "))) == []
    with pytest.raises(ValueError):
        retrieval.bm25_search(chunks, query(spark, "agent"), -1)


def test_lexical(spark):
    chunks = spark.createDataFrame([("0", "agent memory agent"), ("1", "retrieval basics"), ("2", "agent planning")], CHUNK)
    assert ids(retrieval.lexical_search(chunks, query(spark, "agent"))) == ["0", "2"]
    assert ids(retrieval.lexical_search(chunks, query(spark, "retrieval planning"))) == ["1", "2"]
    assert ids(retrieval.lexical_search(chunks, query(spark, "agent"), 0)) == []


def test_semantic(spark):
    index = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.0, 1.0]), ("2", [0.5, 0.5]), ("3", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert ids(retrieval.semantic_search(index, q, 4)) == ["0", "2", "1", "3"]
    assert ids(retrieval.semantic_search(index, q.limit(0), 4)) == []
    with pytest.raises(Exception, match="differ in length"):
        retrieval.semantic_search(index, spark.createDataFrame([(1, [1.0])], q.schema), 4).collect()


def test_semantic_reads_vectors_once_where_they_are(spark):
    """Few queries: vectors, made by a provider, say, are made once, not counted before nor shuffled; those made of the chunks meet no join."""
    chunks = spark.createDataFrame([(str(i), f"text {i}") for i in range(20)], "chunk_id string, text string")
    asked, provider = spark.sparkContext.accumulator(0), providers.hashing_provider(4)

    def counting(texts):
        asked.add(len(texts))
        return provider(texts)

    q = spark.createDataFrame([(1, provider(["text 3"])[0])], "query_id long, embedding array<double>")
    got = retrieval.semantic_search(retrieval.known_vectors(chunks, lambda rows: providers.embed(rows, counting)), q, 1)
    assert "3" in {r["chunk_id"] for r in retrieval.semantic_search(providers.embed(chunks, provider), q, 20).where("score > 0.999").collect()}
    assert got.collect()[0]["score"] > 0.999 and asked.value == 20


def test_semantic_takes_any_number_of_queries(spark):
    index = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    queries = spark.range(70_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("embedding"))
    got = retrieval.semantic_search(index, queries, 1)
    right = F.col("chunk_id") == F.when(F.col("query_id") % 3 == 0, "x").otherwise("y")
    assert got.agg(F.count("*"), F.count_distinct("query_id"), F.min(right)).first()[:] == (70_000, 70_000, True)


def test_semantic_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SCORES", 20)
    rng = random.Random(4)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    index = spark.createDataFrame(vectors, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame(vectors[:25], "query_id long, embedding array<double>")

    def cos(a, b):
        norms = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0

    want = {(q, n + 1, c) for q, v in vectors[:25] for n, (_, c) in enumerate(sorted((-round(cos(v, w), 9), c) for c, w in vectors)[:5])}
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in retrieval.semantic_search(index, asked, 5).collect()} == want


def test_passages_at_every_place(spark):
    texts = ["one two three four five six. One two three four five six", "xone two three four five six; one two three four five six", "a.b a.b a.b", "(a \\E b c) d (a \\E b c) d", "日本 𝒳 fox, foxes", "", None]
    asked = ["one two three four five six", "ne two three", "two three four five", "a.b a.b", "a \\E b c", "fox", "𝒳 fox", "three fou", "", ", ", None]
    documents = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = set()
    for d, t in enumerate(texts):
        for q, p in enumerate(asked):
            starts = [i for i in range(len(t or "")) if p and t.startswith(p, i)]
            want |= {(q, d, n, i, i + len(p)) for n, i in enumerate(starts)}
    got = [tuple(r) for r in evidence.find_passages(documents, passages).select("query_id", "document_id", "place", "start_char", "end_char").collect()]
    assert len(got) == len(want) and set(got) == want


def test_fusion(spark):
    def arm(*names):
        return spark.createDataFrame([(1, i + 1, n) for i, n in enumerate(names)], "query_id long, rank int, chunk_id string")

    rows = retrieval.fuse(arm("a", "b"), arm("b", "c")).orderBy("rank").collect()
    assert rows[0]["chunk_id"] == "b" and math.isclose(rows[0]["score"], 1 / 62 + 1 / 61)
    assert ids(retrieval.fuse(arm("b"), arm("a"))) == ["a", "b"]
    assert [r["chunk_id"] for r in retrieval.fuse(arm("a", "b"), arm("c", "a")).orderBy("rank").collect()] == ["a", "c", "b"]


@pytest.mark.parametrize(("text", "size", "overlap", "want"), [("abcdefghijklmnopqrstuvwxyz", 10, 0, ["abcdefghij", "klmnopqrst", "uvwxyz"]), ("abcdefghijkl", 5, 2, ["abcde", "defgh", "ghijk", "jkl"]), ("", 5, 0, [])])
def test_sliding(spark, text, size, overlap, want):
    got = chunking.sliding_chunks(docs(spark, text), size, overlap).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == want
    assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in got)


def test_split_oversized(spark):
    got = chunking.split_oversized(docs(spark, "abcdefghijklmnopqrstuvwxyz", "short"), 10, 3).orderBy("piece").collect()
    assert [r["text"] for r in got] == ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]
    with pytest.raises(ValueError):
        chunking.split_oversized(docs(spark, ""), 10, 10)


def test_block_chunks(spark):
    rows = [(1, 0, "heading", "h" * 12, 0, 12), (1, 1, "paragraph", "p" * 56, 14, 70), (1, 2, "table", "t" * 200, 72, 272), (1, 3, "paragraph", "", 272, 272), (1, 4, "paragraph", "q", 274, 275), (2, 0, "table", "t", 0, 1)]
    blocks = spark.createDataFrame(rows, "document_id long, block_index int, block_type string, text string, start_char int, end_char int")
    got = chunking.block_chunks(blocks, 100).orderBy("document_id", "chunk_index").collect()
    assert [(r["document_id"], r["start_char"], r["end_char"], r["block_types"]) for r in got] == [(1, 0, 70, ["heading", "paragraph"]), (1, 72, 272, ["table"]), (1, 274, 275, ["paragraph"]), (2, 0, 1, ["table"])]
    assert got[0]["text"] == "h" * 12 + "\n\n" + "p" * 56


def test_oversized_blocks(spark):
    rows = [(1, 0, "paragraph", "p" * 10, 0, 10), (1, 1, "paragraph", "abcdefghijklmnopqrstuvwxyz" * 2, 12, 64), (1, 2, "paragraph", "q" * 10, 66, 76), (1, 3, "table", "t" * 60, 78, 138)]
    blocks = spark.createDataFrame(rows, "document_id long, block_index int, block_type string, text string, start_char int, end_char int")
    got = chunking.block_chunks(blocks, 30, 5).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], len(r["text"]), r["start_char"], r["end_char"], r["exceeds"]) for r in got] == [(0, 10, 0, 10, False), (1, 30, 12, 42, False), (2, 27, 37, 64, False), (3, 10, 66, 76, False), (4, 60, 78, 138, True)]
    assert [len(r["text"]) for r in chunking.block_chunks(blocks, 30, split=False).orderBy("chunk_index").collect()] == [10, 52, 10, 60]


def test_chunk_metadata(spark):
    rows = [(1, 0, "heading", "Title", 0, 5, 1, [], 1, None), (1, 1, "paragraph", "body", 7, 11, 2, ["Title"], None, ["odd"])]
    blocks = spark.createDataFrame(rows, "document_id long, block_index int, block_type string, text string, start_char int, end_char int, page_number int, heading_path array<string>, level int, warnings array<string>")
    row = chunking.block_chunks(blocks, 100).first()
    assert (row["page_start"], row["page_end"], row["heading_path"], row["level"], row["warnings"]) == (1, 2, ["Title"], 1, ["odd"])


def test_markdown(spark):
    text = "# RAG Basics\n\n## Hybrid\n\nCombine lexical.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```python\nx = 1\n# no\n```\n- one\n- two\n> quote\n# Next\ntail"
    got = parse.markdown_blocks(docs(spark, text, "", None)).orderBy("block_index").collect()
    assert [r["block_type"] for r in got] == ["heading", "heading", "paragraph", "table", "code", "list", "blockquote", "heading", "paragraph"]
    assert got[2]["heading_path"] == ["RAG Basics", "Hybrid"] and got[8]["heading_path"] == ["Next"] and got[4]["language"] == "python"
    assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in got)


def test_indented_fences(spark):
    text = "  ```py\na = 1\n # no heading\n   ```\n# Yes\n~~~\nx\n```\n ~~~ and\ntail"
    got = parse.markdown_blocks(docs(spark, text)).orderBy("block_index").collect()
    assert [(r["block_type"], r["language"]) for r in got] == [("code", "py"), ("heading", None), ("code", None), ("paragraph", None)]


def test_lines_and_blocks(spark):
    texts = ["a\n\n b\nc\n", "", None, "\n\t\n", "日本\n𝒳 x"]
    rows = docs(spark, *texts)
    want = set()
    for d, t in enumerate(texts):
        at = 0
        for i, line in enumerate((t or "").split("\n")):
            want.add((d, i, at, line))
            at += len(line) + 1
    assert {tuple(r) for r in parse.lines(rows).collect()} == want
    got = [(r["document_id"], r["block_index"], r["start_char"], r["end_char"], r["text"]) for r in parse.text_blocks(rows).orderBy("document_id", "block_index").collect()]
    assert got == [(0, 0, 0, 1, "a"), (0, 1, 3, 7, " b\nc"), (4, 0, 0, 6, "日本\n𝒳 x")]


def test_tables(spark):
    def shown(rows):
        return spark.createDataFrame([(rows,)], "rows array<array<string>>").select(parse.serialize_table(F.col("rows"))).first()[0]

    assert shown([["Method", "Hit"], ["a|b", " 1\n2 "]]) == "| Method | Hit |\n|---|---|\n| a\\|b | 1 2 |"
    assert shown([["x", ""], ["1"], ["1", "2", "3"]]) == "| x | Column 2 | Column 3 |\n|---|---|---|\n| 1 |  |  |\n| 1 | 2 | 3 |"
    assert shown([[None, " "], []]) == ""


def test_edge_lines(spark):
    page = ["Header", "body a", "Header", "body b", "Footer 1"]
    rows = [(1, p, i, t) for p in range(2) for i, t in enumerate(page)]
    got = parse.repeated_edge_lines(spark.createDataFrame(rows, "document_id long, page int, line_index int, text string"), edge=1).where("removed").collect()
    assert sorted((r["page"], r["line_index"]) for r in got) == [(0, 0), (0, 4), (1, 0), (1, 4)]
    tie = [(1, 0, i, t) for i, t in enumerate(("a", "b", "Tie"))] + [(1, 1, i, t) for i, t in enumerate(("Tie", "d", "e", "f"))] + [(2, 0, 0, "Once"), (2, 0, 1, "Once")]
    got = parse.repeated_edge_lines(spark.createDataFrame(tie, "document_id long, page int, line_index int, text string"), edge=1).where("removed").collect()
    assert [(r["page"], r["line_index"]) for r in got] == [(0, 2)]  # the footer was there first; a document of one page keeps its lines


def test_budget(spark):
    ranked = spark.createDataFrame([(1, i + 1, str(i), "x" * n) for i, n in enumerate((12, 16, 13, 1))], RANKED)
    assert [r["rank"] for r in selection.budget_prefix(ranked, 10).orderBy("rank").collect()] == [1, 2]
    assert [len(r["text"]) for r in selection.context_pack(ranked, 30).orderBy("rank").collect()] == [12, 16, 2]


def shares(caps, left):
    """Characters dealt to results: all the same, what doesn't divide to the first, again until nothing is left or all are full."""
    given = [0] * len(caps)
    while left > 0 and (open_ := [i for i, c in enumerate(caps) if given[i] < c]):
        share, rest = divmod(left, len(open_))
        grants = [(i, min(share + (k < rest), caps[i] - given[i])) for k, i in enumerate(open_)]
        for i, g in grants:
            given[i] += g
        left -= sum(g for _, g in grants)
    return given


def test_allocation(spark):
    rng = random.Random(2)
    lengths = {q: [rng.choice((3, 40, 200, 900)) for _ in range(rng.randint(1, 9))] for q in range(40)}
    rows = [(q, i + 1, str(i), "x" * n, "[h]") for q, ns in lengths.items() for i, n in enumerate(ns)]
    ranked = spark.createDataFrame(rows, RANKED + ", header string")
    got = {}
    for r in selection.allocate(ranked, 1003, 640).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["allocation"])
    assert got == {q: shares([min(n, 640) for n in ns], 1003 - 4 * len(ns) - 2 * (len(ns) - 1)) for q, ns in lengths.items()}
    with pytest.raises(Exception, match="too small"):
        selection.allocate(ranked, 20, 640).collect()


def test_windows(spark):
    rows = spark.createDataFrame([(1, "x" * 1000, 448), (2, "short", 448), (3, "", 448)], "id long, text string, allocation int")
    got = selection.fragment_windows(rows).where("id = 1").orderBy("window_start").collect()
    assert got[0]["window_start"] == 0 and got[-1]["window_end"] == 1000 and all(len(r["window_text"]) <= 448 for r in got)
    assert selection.fragment_windows(rows).where("id = 2").count() == 1 and selection.fragment_windows(rows).where("id = 3").isEmpty()
    text = "a" * 60 + ". " + "b" * 100
    found = selection.fragment_windows(spark.createDataFrame([(1, text, 100)], "id long, text string, allocation int"), 50).orderBy("window_start").collect()
    assert found[0]["window_text"] == "a" * 60 + "." and [r["window_start"] for r in found] == [0, 62]


def test_window_scores(spark):
    rows = [(1, "the risk of the market", "risk market risk of", ["market"]), (1, "the of", "of the of", [])]
    made = spark.createDataFrame(rows, "id long, q string, w string, signal_tokens array<string>")
    made = made.select("id", "signal_tokens", F.split("q", " ").alias("query_tokens"), F.split("w", " ").alias("window_tokens"))
    got = [(r["n_unique"], r["n_occurrences"], r["n_bigrams"], r["n_signals"]) for r in selection.fragment_scores(made).collect()]
    assert got == [(2, 3, 1, 1), (2, 3, 1, 0)]


@pytest.mark.parametrize(("span", "chunks", "want"), [((20, 60), [(0, 100)], [1.0]), ((50, 150), [(0, 100), (100, 200)], [0.5, 0.5]), ((0, 100), [(80, 100)], [])])
def test_mapping(spark, span, chunks, want):
    spans = spark.createDataFrame([("s", "C:/repo/docs/rag.md", *span)], "span_id string, source_path string, start_char int, end_char int")
    pieces = spark.createDataFrame([(str(i), "docs/rag.md", *c) for i, c in enumerate(chunks)], "chunk_id string, source_path string, start_char int, end_char int")
    assert [r["overlap_ratio"] for r in evidence.map_spans(spans, pieces).orderBy("chunk_id").collect()] == want


def test_mapping_by_pages_and_source(spark):
    spans = spark.createDataFrame(
        [("range", "a/b.md", 0, 10, None, None), ("page", "b.md", None, None, 3, None), ("far", "b.md", 5000, 5010, 1, 2), ("bare", "a\\b.md/", None, None, None, None), ("gone", "x.md", 0, 5, 1, 1), ("lost", "b.md", 9000, 9005, None, None)],
        "span_id string, source_path string, start_char int, end_char int, page_start int, page_end int",
    )
    chunks = spark.createDataFrame([("c1", "a/b.md", 0, 100, 1, 2), ("c2", "a/b.md", 100, 200, 2, 3), ("c3", "ab.md", 0, 100, 1, 9)], "chunk_id string, source_path string, start_char int, end_char int, page_start int, page_end int")
    got = sorted((r["span_id"], r["chunk_id"], r["method"], r["kind"]) for r in evidence.map_spans(spans, chunks, source_only=True).collect())
    assert got == [("bare", "c1", "source_only", "exact"), ("bare", "c2", "source_only", "exact"), ("far", "c1", "page_overlap", "suffix"), ("far", "c2", "page_overlap", "suffix"), ("page", "c2", "page_overlap", "suffix"), ("range", "c1", "char_overlap", "exact")]
    mapped = evidence.map_spans(spans, chunks)
    assert sorted(r["span_id"] for r in evidence.unmatched_spans(spans, mapped).collect()) == ["bare", "gone", "lost"]
    long = spark.createDataFrame([("s", "p", 4000, 13000)], "span_id string, source_path string, start_char int, end_char int")
    wide = spark.createDataFrame([("c", "p", 0, 20000), ("d", "p", 4000, 8200), ("e", "p", 12900, 20000)], "chunk_id string, source_path string, start_char int, end_char int")
    assert sorted((r["chunk_id"], round(r["overlap_ratio"], 3)) for r in evidence.map_spans(long, wide).collect()) == [("c", 1.0), ("d", 0.467)]


def test_passages_by_join(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SENT_CHARACTERS", -1)
    test_passages_at_every_place(spark)


def test_searches_by_join(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(300)], CHUNK)
    queries = spark.createDataFrame([(str(i), " ".join(rng.choices([*words, "absent"], k=4))) for i in range(20)], "query_id string, query string")
    for search, limit in ((retrieval.bm25_search, 7), (retrieval.lexical_search, 5)):
        narrow = search(chunks, queries, limit).collect()
        with monkeypatch.context() as m:
            m.setattr(retrieval, "SENT_TOKENS", 0)
            joined = search(chunks, queries, limit).collect()
        assert sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in narrow) == sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in joined)


def test_failures(spark):
    gold = spark.createDataFrame([(q, f"g{q}") for q in (1, 4, 5, 6)], "query_id long, chunk_id string")
    results = spark.createDataFrame(
        [(1, 1, "x", "a.md"), (1, 2, "g1", "a.md"), (3, 1, "x", "a.md"), (4, 1, "x", "z.md"), (5, 1, "x", "in/s5.md"), (6, 1, "x", "q.md"), (7, 1, "x", "q.md"), (8, 1, "x", "k/p.md")], "query_id long, rank int, chunk_id string, source_path string"
    )
    spans = spark.createDataFrame([(3, "s", "a.md", False), (4, "t", "s4.md", True), (5, "u", "s5.md", True)], "query_id long, span_id string, source_path string, mapped boolean")
    cases = spark.createDataFrame([(q, ["p.md"] if q in (2, 8) else None) for q in range(1, 9)], "query_id long, expected_paths array<string>")
    want = {1: "passed", 2: "no_result", 3: "unmapped_evidence", 4: "missed_source", 5: "wrong_section", 6: "low_rank", 7: "unknown", 8: "passed"}
    assert {r["query_id"]: r["failure"] for r in evaluate.failures(cases, results, gold, spans).collect()} == want
    late = evaluate.failures(cases, results.where("query_id = 1"), gold, None, 1).where("query_id = 1").first()
    assert late["failure"] == "low_rank"  # a hit beyond k is none


def test_source_cases(spark):
    results = spark.createDataFrame([(1, i + 1, c, p, "x" * n) for i, (c, p, n) in enumerate((("a", "in/p.md", 30), ("b", "p.md", 10), ("c", "xp.md", 10), ("d", "q.md", 50)))], "query_id long, rank int, chunk_id string, source_path string, text string")
    cases = spark.createDataFrame([(1, ["q.md", "p.md", "r.md"]), (2, ["p.md"])], "query_id long, expected_paths array<string>")
    got = {r["query_id"]: r for r in evaluate.case_results(cases, results, spark.createDataFrame([], "query_id long, chunk_id string"), 4).collect()}
    row = got[1]
    assert (row["rank"], row["matched_by"], row["relevant_ranks"], row["n_expected"], row["recall"], row["precision"], row["density"], row["context_tokens"]) == (1, "source_path", [1, 4], 3, 0.0, 0.5, 0.8, 25)
    assert (got[2]["rank"], got[2]["matched_by"], got[2]["ndcg"], got[2]["n_retrieved"]) == (None, "none", 0.0, 0)


def test_rehydration(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, chunk_id string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], CHUNK)
    assert [r["text"] for r in retrieval.rehydrate(ranked, chunks).orderBy("rank").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="missing"):
        retrieval.rehydrate(ranked, chunks.limit(1)).collect()
    with pytest.raises(Exception, match="gaps"):
        retrieval.rehydrate(ranked.where("rank = 2"), chunks).collect()


def test_formula_lines(spark):
    lines = {"RRF (x) sums": True, "the MRR is": True, "a | b | 3": False, "50% of 3 apples": False, "x = 3": True, "well-known 3rd": True, "x ≤ 4": True, "α1 b": True, "no signs 3": False, "= 3": False, "hit@five": True}
    rows = spark.createDataFrame([(x,) for x in lines], "text string").select("text", T.formula_line(F.col("text")).alias("f"))
    assert {r["text"]: r["f"] for r in rows.collect()} == lines


def test_coverage(spark):
    spans = spark.createDataFrame([("s", 0, 100), ("t", 0, 10)], "span_id string, start_char int, end_char int")
    ranges = spark.createDataFrame([("s", 0, 30), ("s", 10, 20), ("s", 20, 50), ("s", 90, 200)], "span_id string, start_char int, end_char int")
    assert {r["span_id"]: r["coverage"] for r in evidence.coverage(spans, ranges).collect()} == {"s": 0.6, "t": 0.0}
    pages = "page_start int, page_end int"
    spans = spark.createDataFrame([("p", None, None, 2, 5), ("n", None, None, None, None)], f"span_id string, start_char int, end_char int, {pages}")
    ranges = spark.createDataFrame([("p", 0, 1, 1, 2), ("p", 0, 1, 2, None), ("p", 0, 1, 5, 9), ("n", 0, 1, 1, 1)], f"span_id string, start_char int, end_char int, {pages}")
    assert {r["span_id"]: r["coverage"] for r in evidence.coverage(spans, ranges).collect()} == {"p": 0.5, "n": None}


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "query_id long, chunk_id string")
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "c"), (1, 4, "a")], "query_id long, rank int, chunk_id string")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: r for r in evaluate.case_metrics(cases, results, gold).collect()}
    assert round(got[1]["ndcg"], 4) == 0.9197 and got[1]["precision"] == 0.4 and got[1]["recall"] == 1.0 and got[2]["recall"] == 0.0 and got[3]["ndcg"] == 0.0
    assert evaluate.latencies(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double"), "v").first()["p50"] == 2.5


def test_fingerprint_ignores_order(spark):
    rows = [(f"c{i}", f"h{i}") for i in range(50)]
    a, b = (represent.index_fingerprint(spark.createDataFrame(x, "chunk_id string, text_hash string")).first() for x in (rows, rows[::-1]))
    assert a == b and a["n_chunks"] == 50


def test_migration(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "schema_version int")
    assert {r[0] for r in history.migrate(rows).collect()} == {2}
    with pytest.raises(Exception, match="unknown schema version"):
        history.migrate(spark.createDataFrame([(3,)], "schema_version int")).collect()

"""Page layout, gates, numbering, providers, sessions and the engine on small inputs."""

import hashlib
import json
import os
import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.functions import unicode as U
from plinth.operators import evidence, gates, history, pages, parse, represent, selection
from plinth.operators.numbering import numbered
from plinth.plans import more_plans, text_plans
from plinth.plans.engine import Engine, listed
from plinth.sources import providers, shared

WORD = "document_id long, page int, x0 double, x1 double, top double, text string"
LINE = "document_id long, page int, line_index int, top double, x0 double, text string"


def test_reading_lines(spark):
    rows = [(1, 0, 50.0, 60.0, 10.0, "b"), (1, 0, 10.0, 20.0, 11.0, "a"), (1, 0, 300.0, 310.0, 10.5, "far"), (1, 0, 10.0, 20.0, 30.0, "next")]
    got = pages.reading_lines(spark.createDataFrame(rows, WORD)).orderBy("line_index").collect()
    assert [r["text"] for r in got] == ["a b", "far", "next"]
    slanted = [(1, 0, 10.0 * i, 10.0 * i + 5, 2.0 * i, f"w{i}") for i in range(6)] + [(1, 0, 0.0, 1.0, 99.0, " ")]
    got = pages.reading_lines(spark.createDataFrame(slanted, WORD)).orderBy("line_index").collect()
    assert [r["text"] for r in got] == ["w0 w1 w2", "w3 w4 w5"]  # each word is near the one before, but not near its line's mean


def test_columns(spark):
    rows = [(1, 0, i, float(10 * (i // 2)), 50.0 if i % 2 == 0 else 400.0, f"{'lr'[i % 2]}{i // 2}") for i in range(6)]
    got = pages.column_order(spark.createDataFrame(rows, LINE), 600.0).orderBy("place").collect()
    assert [r["text"] for r in got] == ["l0", "l1", "l2", "r0", "r1", "r2"]
    one = pages.column_order(spark.createDataFrame(rows[:1] + rows[2:3], LINE), 600.0).collect()
    assert {r["column"] for r in one} == {0}


def test_tables_and_captions(spark):
    lines = spark.createDataFrame([(1, 0, 0, 5.0, 0.0, "Table 1 results"), (1, 0, 1, 8.0, 0.0, "Table 2 others"), (1, 0, 2, 20.0, 0.0, "alpha 10 beta"), (1, 0, 3, 30.0, 0.0, "words around it")], LINE)
    tables = spark.createDataFrame([(1, 0, 0, 7.0, "| alpha | 10 |\n| beta | 20 |"), (1, 0, 1, 12.0, "| z |"), (1, 0, 2, None, "| y |")], "document_id long, page int, table_index int, top double, text string")
    assert [r["line_index"] for r in pages.outside_tables(lines, tables).orderBy("line_index").collect()] == [0, 1, 3]
    found = pages.captions(tables, lines)
    assert [r["caption"] for r in found.orderBy("table_index").collect()] == ["Table 1 results", "Table 2 others", "Table 1 results"]
    figures = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, "Figure 1 no table"), (1, 0, 1, 2.0, 0.0, "Tables are good"), (1, 0, 2, 3.0, 0.0, "TABLE IV. Sums")], LINE)
    assert [r["caption"] for r in pages.captions(tables.limit(1), figures).collect()] == ["TABLE IV. Sums"]
    text = pages.page_text(spark.createDataFrame([(1, 0, " ", "plain"), (1, 1, "words", None), (1, 2, None, None)], "document_id long, page int, words_text string, plain_text string"))
    assert [(r["text"], r["fallback"]) for r in text.orderBy("page").collect()] == [("plain", True), ("words", False), ("", True)]
    blocks = pages.page_blocks(text.select("document_id", "page", "text"), found).orderBy("block_index").collect()
    assert [(r["block_type"], r["page"]) for r in blocks] == [("paragraph", 0), ("table", 0), ("table", 0), ("table", 0), ("paragraph", 1)]
    warned = pages.page_warnings(text, found.withColumn("malformed", F.col("table_index") == 1)).collect()
    assert sorted((r["page"], r["warning"]) for r in warned) == [(0, "malformed table"), (0, "no words"), (2, "empty page")]
    assert blocks[1]["text"].startswith("Table 1 results\n\n| alpha")


def test_read_pages(spark):
    words = [(1, p, 10.0 * i, 10.0 * i + 8, 12.0 * k, w) for p in range(3) for k, line in enumerate(("Big Report", f"body of page {p}", "a 1 b 2", "more of it", f"tail {p}", "the end")) for i, w in enumerate(line.split())]
    tables = pages.page_tables(spark.createDataFrame([(1, 1, 1, 20.0, [["a", "1"], ["b", "2"]])], "document_id long, page int, table_index int, top double, rows array<array<string>>"), spark.createDataFrame([(1, 1, 1, [["x"]]), (1, 2, 1, [["y", "z"], ["q"]]), (1, 2, 2, [[" "]])], "document_id long, page int, table_index int, rows array<array<string>>"))
    assert [(r["page"], r["text"], r["malformed"]) for r in tables.orderBy("page").collect()] == [(1, "| a | 1 |\n|---|---|\n| b | 2 |", False), (2, "| y | z |\n|---|---|\n| q |  |", True)]
    rows = spark.createDataFrame([(1, 1, "a 1"), (1, 1, "b 2")], "document_id long, page int, text string")
    plain = spark.createDataFrame([(1, p, "plain") for p in range(4)], "document_id long, page int, plain_text string")
    got = pages.read_pages(spark.createDataFrame(words, WORD), tables, rows, plain, 1000.0).orderBy("block_index").collect()
    want = [(0, "body of page 0\na 1 b 2\nmore of it\ntail 0"), (1, "body of page 1\nmore of it\ntail 1"), (1, "| a | 1 |\n|---|---|\n| b | 2 |"), (2, "body of page 2\na 1 b 2\nmore of it\ntail 2"), (2, "| y | z |\n|---|---|\n| q |  |"), (3, "plain")]
    assert [(r["page"], r["text"]) for r in got] == want
    assert pages.document_text(pages.page_blocks(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "document_id long, page int, text string"), pages.captions(tables.limit(0), spark.createDataFrame([], LINE)))).first()["text"] == "a\n\nb"


def test_packed_pages_give_the_lines_of_words(spark):
    """Whole pages, read where they stand, against the operators over words and lines: slants, gaps, columns, ties, blanks, odd blanks."""
    rng, words = random.Random(4), []
    for p in range(60):
        steps = rng.choice([(12.0,), (0.5, 2.0, 4.0), (3.0,)])
        tops = [0.0]
        for _ in range(rng.choice([1, 4, 25])):
            tops.append(tops[-1] + rng.choice(steps))
        for top in tops:
            for _ in range(rng.choice([1, 2, 6])):
                x0 = rng.choice([0.0, 10.0, 40.0, 300.0, 520.0, 700.0])
                words.append((p // 7, p % 7, x0, x0 + rng.choice([5.0, 30.0]), top + rng.choice([0.0, 0.0, 1.0]), rng.choice(["a", "b", "é", "\U0001d400", "\uffee", " c ", "", " \t", "\u3000d\xa0", "Table 1 x"])))
    df = spark.createDataFrame([*words, (9, 0, 1.0, 2.0, 3.0, " ")], WORD)
    lines = pages.reading_lines(df)
    tops = lines.select("document_id", "page", "line_index", "top")
    want = pages.column_order(lines, 700.0).join(tops, ["document_id", "page", "line_index"]).orderBy("document_id", "page", "place")
    want = [(r["document_id"], r["page"], r["line_index"], r["column"], r["top"], r["text"]) for r in want.collect()]
    got = pages.packed_lines(pages.packed(df).repartition(3), 700.0).orderBy("document_id", "page").collect()
    assert [(r["document_id"], r["page"], *x) for r in got for x in r["lines"]] == want
    assert len({(w[0], w[1]) for w in want if w[3]}) > 3 and (9, 0) not in {(r["document_id"], r["page"]) for r in got}
    assert pages.packed_lines(pages.packed(df.limit(0)), 700.0).count() == 0
    null = spark.createDataFrame([(1, 0, None)], "document_id long, page int, words array<struct<x0:double,x1:double,top:double,text:string>>")
    assert pages.packed_lines(null, 700.0).count() == 0


def test_pages_with_line_feeds_in_words(spark):
    """A line that holds a line feed stays one line where headers, footers and table rows go."""
    words = [(1, p, 0.0, 5.0, 10.0 * k, w) for p in range(3) for k, w in enumerate(("Head\nline", f"a\nb {p}", "c 1 d 2", "of all", f"tail\n{p}", "the\nend"))]
    tables = spark.createDataFrame([], "document_id long, page int, table_index int, top double, text string")
    rows = spark.createDataFrame([(1, 1, "c 1 d 2")], "document_id long, page int, text string")
    plain = spark.createDataFrame([(1, p, "plain") for p in range(3)], "document_id long, page int, plain_text string")
    got = pages.read_pages(spark.createDataFrame(words, WORD), tables, rows, plain, 1000.0).orderBy("block_index").collect()
    assert [r["text"] for r in got] == [f"a\nb {p}\n" + ("" if p == 1 else "c 1 d 2\n") + f"of all\ntail\n{p}" for p in range(3)]


def test_page_files_hold_each_page_once(spark, tmp_path):
    """Documents of one id share their pages; the files hold the words of all, and a caption a page."""
    texts = [(1, "a b | c\nx  y\n" + "\n" * 9 + "tail | of it"), (1, 'quo"te \\n é\t| \u2028z'), (2, " "), (3, None), (None, "no id"), (4, "w " * 30 + "| end")]
    spark.createDataFrame([(*t, "s", "en") for t in texts], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = more_plans.captioned_pages_of(spark, str(tmp_path))
    assert got.count() == got.select("document_id", "page").distinct().count() == 3
    flat = got.select("document_id", "page", F.explode("words").alias("w")).select("document_id", "page", "w.*")
    want = more_plans.words_of(spark, str(tmp_path)).where("document_id is not null")
    captions = [(d, p, 40.0 * w, 40.0 * w + 30, -12.0, t) for d, p in ((1, 0), (1, 1), (4, 0)) for w, t in enumerate(("Table", str(p + 1), "lines"))]
    assert sorted(map(tuple, flat.collect())) == sorted([*map(tuple, want.collect()), *captions])


def test_pages_take_little_disk(spark, sf_dir):
    """Words are written once, compressed, and not shuffled: what the query keeps is less than twice its text."""

    def kept():
        folder = shared.shared_folder(spark).removeprefix("file://")
        return sum(os.stat(os.path.join(at, name)).st_size for at, _, names in os.walk(folder) for name in names if name.startswith("part-"))

    before = kept()
    more_plans.page_blocks(spark, sf_dir)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < kept() - before < 2 * text


def test_headings(spark):
    pages_ = {
        "12\nThe Theory of Large Graphs\nbody": (["The Theory of Large Graphs"], "The Theory of Large Graphs"),
        "plain words\nSection two begins\nLemma 3 holds for all\n1.2 Sparse Index Methods Here": (["Section two begins", "Lemma 3 holds for all", "1.2 Sparse Index Methods Here"], "1.2 Sparse Index Methods Here"),
        "1.2 of the smaller things\n1.3 x = y\n1.4 Theorem of Bayes": (["1.2 of the smaller things", "1.4 Theorem of Bayes"], None),
        "Cambridge University Press Series\nA sentence, with commas": ([], None),
        "7 The Growth of Networks\n(cid:3)Example 4 is short\nexample 4 IS SHORT": (["The Growth of Networks", "Example 4 is short"], "The Growth of Networks"),
        "": ([], None),
    }
    rows = spark.createDataFrame(list(enumerate(pages_)), "id int, text string").select("id", represent.heading_scan(F.col("text"), F.array(F.lit("Cambridge  university"))).alias("s"))
    assert [(r["s"]["local"], r["s"]["holds"]) for r in rows.orderBy("id").collect()] == list(pages_.values())


def test_representations(spark):
    rows = spark.createDataFrame(
        [("a", "d", 0, "docs/one.pdf", "Chapter two of all\nText with hy-\nphen (cid:7) here\n3", None, 2, 3, ["table"], ["Recall@5 = 0.5", "no formula", "recall@5 = 0.5", "x² ≤ 4"]), ("b", "d", 1, "docs/one.pdf", "plain body", None, 4, None, None, None), ("c", "e", 0, "/abs/two.md", "x", ["Top", "Sub"], None, None, None, None)],
        "chunk_id string, document_id string, chunk_index int, source_path string, text string, heading_path array<string>, page_start int, page_end int, block_types array<string>, formula_lines array<string>",
    )
    got = {r["chunk_id"]: r["representation"] for r in represent.representations(rows, "cleaned_pdf_formula_text_v1").collect()}
    assert got["a"] == "Document title: one\nSource: docs/one.pdf\nSection: Chapter two of all\nPage: 2-3\nBlock types: table\nSignals: table\nFormula evidence: Recall@5 = 0.5 | x2 <= 4\nContent:\nChapter two of all Text with hyphen here"
    assert "Section: Chapter two of all\nPage: 4\nBlock types: unknown\nSignals: none\nFormula evidence: none\nContent:\nplain body" in got["b"]
    assert got["c"] == "Document title: Top\nSource: two.md\nSection: Top > Sub\nPage: unknown\nBlock types: unknown\nSignals: none\nContent:\nx"
    assert represent.representations(rows).where("chunk_id = 'b'").first()["representation"] == "plain body"
    with pytest.raises(Exception, match="nothing is left"):
        represent.representations(rows.withColumn("text", F.lit("3")), "cleaned_pdf_section_text_v1").collect()
    with pytest.raises(ValueError):
        represent.representations(rows, "other")


def test_representations_of_page_numbers_alone(spark, tmp_path):
    """A chunk of which cleaning leaves nothing keeps its row in cleaned_text, as in the SQL."""
    docs = [(2, "12\n\n(cid:3)", "en", "web", 10), (4, "x" * 899 + " 2024" + "y" * 95, "en", "web", 999), (6, "z" * 900 + "7", "en", "web", 901), (3, "5", "en", "web", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in text_plans.cleaned_text(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(more_plans.SQL["cleaned_text"]).fetchall()) and len(got) == 6


def test_few_words_are_spelled_out_at_once():
    """A batch of 2 million words, whose strings together would take more than 100 MB."""
    batch = pa.array(["Ab straße " * 2_500] * 400 + [None, ""])
    tracemalloc.start()
    got = U.folded_tokens.func(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == ["ab", "strasse"] * 2_500 and got[400].as_py() is None and got[401].as_py() == [] and len(got) == 402
    assert most < 40e6


def test_reading_lines_fold_tops(spark):
    """As many states as tops, not as words: a line of 20,000 words in a page, which a fold over words would copy 20,000 times; one exchange."""
    words = [(1, 0, 40.0 * w, 40.0 * w + 30.0, 12.0 * (w % 2) * 0.2, f"w{w}") for w in range(20_000)] + [(1, 0, 0.0, 10.0, 30.0, "below"), (1, 0, 200.0, 210.0, 30.0, "apart")]
    lines = pages.reading_lines(spark.createDataFrame(words, WORD))
    got = [(r["line_index"], r["top"], r["x0"], r["x1"], len(r["text"].split(" "))) for r in lines.orderBy("line_index").collect()]
    assert got == [(0, 0.0, 0.0, 799_990.0, 20_000), (1, 30.0, 0.0, 10.0, 1), (2, 30.0, 200.0, 210.0, 1)]
    plan = pages.column_order(lines, 600.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("n", [0, 1, 1_000_300])
def test_listed_fingerprint_of_any_length(spark, n):
    """More rows than one million, and one or none: the digest of the JSON list in order."""
    hashes = spark.range(n).select(F.format_string("c/%07d", F.lit(n) - F.col("id")).alias("chunk_id"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text_hash"))
    listed_ = ({"chunk_id": f"c/{n - i:07d}"} | ({"text_sha256": str(i)} if i % 7 else {}) for i in reversed(range(n)))
    want = hashlib.sha256(json.dumps(list(listed_), separators=(",", ":")).encode()).hexdigest()
    assert [r[0] for r in represent.listed_fingerprint(hashes, 1000 if n < 2 else represent.PIECE).collect()] == [want]


def test_spans(spark):
    rows = [(1, 0, "paragraph", "a " * 100, 0, 200), (1, 1, "paragraph", "b " * 100, 202, 402), (1, 2, "table", "| t |", 404, 409), (1, 3, "paragraph", "short", 411, 416), (2, 0, "paragraph", "word " * 400, 0, 2000)]
    blocks = spark.createDataFrame(rows, "document_id long, block_index int, block_type string, text string, start_char int, end_char int")
    got = evidence.build_spans(blocks).orderBy("span_id").collect()
    assert [(r["span_id"], r["start_char"], r["end_char"], r["n_chars"]) for r in got] == [("1::span-0000", 0, 402, 402), ("1::span-0001", 404, 409, 5), ("2::span-0000", 0, 1199, 1199)]
    kinds = spark.createDataFrame([("a/b", "a/b"), ("x/a/b", "a/b"), ("b", "a/b"), ("ab", "b")], "p string, q string")
    assert [r[0] for r in kinds.select(evidence.path_match(F.col("p"), F.col("q"))).collect()] == ["exact", "suffix", "suffix", "none"]


def test_runs(spark):
    samples = spark.createDataFrame([("a", t, s, float(10 * t + s)) for t in range(2) for s in range(3)], "mode string, trial int, seq int, latency_ms double")
    row = gates.cold_and_warm(samples, "mode").first()
    assert (row["cold_ms"], row["warm_ms"]) == (5.0, 6.5)
    results = spark.createDataFrame([(0, 1, 1, "a"), (1, 1, 1, "a"), (0, 2, 1, "a"), (1, 2, 1, "b")], "trial int, query_id long, rank int, chunk_id string")
    assert [r["n_rankings"] for r in gates.stable_rankings(results).orderBy("query_id").collect()] == [1, 2]
    got = gates.gates(spark.createDataFrame([(0.5, None)], "recall double, mrr double"), {"recall": (">=", 0.5), "mrr": ("<=", 1.0)}).collect()
    assert {r["gate"]: r["passed"] for r in got} == {"recall": True, "mrr": False}
    done = spark.createDataFrame([("bm25", 5, 0)], "mode string, k int, repetition int")
    assert gates.open_trials(spark.createDataFrame([("bm25",)], "mode string"), [5, 10], 2, done).count() == 3
    assert gates.checks(spark.range(1), a=F.lit(True), b=F.lit(None).cast("boolean")).first()["all_passed"] is False
    points = spark.createDataFrame([(i, float(p)) for i, p in enumerate((0, 1, 5, 10))], "id long, position double")
    assert [r["id"] for r in gates.farthest(points, 3).orderBy("place").collect()] == [0, 3, 2] and gates.farthest(points.limit(0), 2).count() == 0


def test_reviews(spark):
    cases = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2")], "query_id long, query string, answer string")
    hashed = cases.select("query_id", gates.case_hash(F.col("query"), F.col("answer")).alias("original_hash"))
    made = hashed.withColumns({"decision": F.when(F.col("query_id") == 1, "approved").otherwise("corrected"), "new_query": F.lit(None).cast("string"), "new_answer": F.when(F.col("query_id") == 2, "b")})
    got = gates.review(cases, made).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, "q1", "a1", False), (2, "q2", "b", True)]
    for wrong, said in ((made.where("query_id = 1"), "needs one decision"), (made.union(made), "needs one decision"), (made.withColumn("original_hash", F.lit("x")), "changed since"), (made.withColumn("decision", F.lit("maybe")), "unknown decision")):
        with pytest.raises(Exception, match=said):
            gates.review(cases, wrong).collect()


def test_generated_cases(spark):
    spans = spark.createDataFrame([(f"s{i}", "text") for i in range(5)], "span_id string, text string")
    answers = spark.createDataFrame([("s0", '{"question": " q ", "answer": "a"}'), ("s1", "no"), ("s2", '{"question": "q", "answer": "a", "more": 1}'), ("s3", '{"question": "", "answer": "a"}')], "span_id string, answer string")
    cases, lost = gates.generated_cases(spans, lambda prompts: answers)
    assert [tuple(r) for r in cases.collect()] == [("synthetic-span-000001", "s0", "q", "a")]
    assert {r["span_id"]: r["reason"] for r in lost.collect()} == {"s1": "not the JSON that was asked for", "s2": "not the JSON that was asked for", "s3": "an empty field", "s4": "no answer"}


def test_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert numbered(rows, "v").where("v <> number").isEmpty()


def test_embeddings(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None)], "chunk_id string, text string")
    provider = providers.hashing_provider(8)
    got = {r["chunk_id"]: r["embedding"] for r in providers.embed(rows, provider).collect()}
    assert got["a"] == got["b"] and got["c"] == [0.0] * 8
    known = providers.embed(rows.where("chunk_id = 'a'"), provider)
    again = {r["chunk_id"]: r["embedding"] for r in providers.embed_missing(rows, known, provider).collect()}
    assert again == got
    report = providers.cache_report(rows, known.select("text_hash", "embedding")).first()
    assert (report["hits"], report["misses"], report["new_texts"]) == (2, 1, 1)
    assert providers.in_place([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        providers.in_place([(1, [2.0]), (1, [1.0])], 2)
    with pytest.raises(Exception, match="finite"):
        providers.embed(rows, lambda texts: [[float("nan")]] * len(texts)).collect()
    with pytest.raises(Exception, match="0 vectors for"):
        providers.embed(rows, lambda texts: []).collect()


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "b", False, True, 5, 0, 1), (2, "a", True, False, 1, 2, 0), (3, "c", False, False, 9, 0, 0)], "session_id long, title string, pinned boolean, starred boolean, t long, n_failed long, n_sources long")
    rows = rows.withColumn("updated_at", F.timestamp_seconds("t"))
    assert [r["session_id"] for r in history.listed(rows).orderBy("place").collect()] == [2, 1, 3]
    assert [r["session_id"] for r in history.filtered(rows, "failed").collect()] == [2] and [r["session_id"] for r in history.filtered(rows, "has-sources").collect()] == [1]
    with pytest.raises(ValueError):
        history.filtered(rows, "other")


def test_folding(spark):
    row = spark.createDataFrame([("ＡＢｃ Straße ﬁ", None)], "a string, b string").select(U.fold("a"), U.folded_tokens("a"), U.fold("b")).first()
    assert (row[0], row[1], row[2]) == ("abc strasse fi", ["abc", "strasse", "fi"], None)


def test_engine(spark):
    chunks = spark.createDataFrame([("a", "agent memory"), ("b", "agent planning"), ("c", "other")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "agent memory"), (2, "  ")], "query_id long, query string")
    engine = Engine(chunks).keep("s1")
    assert [r["chunk_id"] for r in engine.search(queries, "bm25").orderBy("rank").collect()] == ["a", "b"]
    asked = {r["query_id"]: r["status"] for r in engine.ask(queries).collect()}
    assert asked == {1: "not_configured", 2: "not_configured"}
    answered = engine.ask(queries, lambda p: p.select("query_id", F.lit("yes").alias("answer"))).collect()
    assert {r["query_id"]: r["status"] for r in answered} == {1: "success", 2: "skipped"}
    gold = spark.createDataFrame([(1, "b")], "query_id long, chunk_id string")
    got = {(r["mode"], r["k"]): r["hit_rate"] for r in engine.compare(queries, gold, ["bm25", "lexical"], [1, 2]).collect()}
    assert got == {("bm25", 1): 0.0, ("bm25", 2): 0.5, ("lexical", 1): 0.0, ("lexical", 2): 0.5}
    stages = engine.stages(queries, "bm25", 1).orderBy("stage_index").collect()
    assert [(r["stage"], r["status"], r["n_in"], r["n_out"]) for r in stages] == [("normalize", "done", 2, 1), ("candidates", "done", 1, 1), ("deduplicate", "done", 1, 1), ("rerank", "skipped", 1, 1), ("select", "done", 1, 1), ("budget", "done", 1, 1)]
    assert engine.keep("s1").keep("s2").statistics == {"loads": 2, "hits": 1, "invalidations": 1}
    rows = engine.compare(queries, gold, ["bm25", "semantic"], [1], fail_fast=False).collect()
    assert {r["mode"]: r["error"] is None for r in rows} == {"bm25": True, "semantic": False}
    with pytest.raises(ValueError):
        engine.compare(queries, gold, ["semantic"], [1])
    assert listed(" bm25, hybrid,,bm25 ") == ["bm25", "hybrid"]
    with pytest.raises(ValueError):
        engine.search(queries, "semantic")
    with pytest.raises(ValueError):
        engine.search(queries, "other")


CASE = "mode string, query_id long, parent_hit boolean, candidate_hit boolean, hit boolean, parent_missed boolean, missed boolean, within boolean, n_kept int, last_kept int, chars_kept long, chars_all long, parent_chars long"


def test_gates_of_modes(spark):
    data = [
        ("a", 1, True, True, True, False, False, True, 2, 2, 10, 20, 10), ("a", 2, True, True, False, False, True, True, 0, 0, 0, 30, 10), ("b", 1, False, True, True, True, True, False, 3, 5, 50, 50, 100), ("b", 2, True, True, None, False, False, True, 1, 1, 10, 50, 20),
    ]
    rows = spark.createDataFrame(data, CASE)
    found = {r["gate"]: (r["value"], r["passed"], r["cases"]) for r in gates.replay_gates(rows, "a", "b", 10, (1, 0), 0.6).collect()}
    assert found == {
        "a_hits_retained": (1.0, True, "a:2"), "b_hits_retained": (1.0, False, "b:2"), "contexts_nonempty": (1.0, False, "a:2"), "contexts_within_budget": (1.0, False, "b:1"), "ranked_prefix_kept": (1.0, False, "b:1"), "b_context_tokens": (0.6, True, ""),
    }
    found = {r["gate"]: (r["value"], r["passed"], r["cases"]) for r in gates.direction_gates(rows, "a", "b", (0.0, 0.5), (1, 1), 0.4).collect()}
    assert found == {
        "a_context_hits_retained": (1.0, True, "a:2"), "b_context_hits_retained": (1.0, True, "b:2"), "no_new_missed_source": (1.0, False, "a:2"), "invariants": (1.0, False, "b:1"), "a_hit_direction": (0.0, True, ""), "b_hit_direction": (0.5, True, ""), "b_context_tokens": (0.5, False, ""),
    }
    packed = rows.withColumns({"scorable": F.lit(True), "oracle_hit": F.col("query_id") == 1, "n_results": F.col("n_kept"), "n_fragments": F.col("last_kept"), "n_lost": F.lit(0), "chars": F.col("chars_kept"), "budget": F.lit(40), "n_unmapped": F.lit(0), "held": F.lit(0.5), "efficiency": F.lit(0.9)})
    found = {r["gate"]: r["passed"] for r in gates.fragment_gates(packed, {"a": 0, "b": 1}, "b").collect()}
    assert len(found) == 9 and {g for g, ok in found.items() if not ok} == {"a_fragment_hits_retained", "oracle_evidence_reachable", "all_candidates_represented", "contexts_within_budget"}
    confirmed = {r["gate"]: r["passed"] for r in gates.fragment_gates(packed, {"a": 1, "b": 1}, "b", inputs=("window_tokens",), coverage=(0.6, 0.4, 0.8)).collect()}
    assert len(confirmed) == 16 and not confirmed["a_coverage"] and not confirmed["selector_isolated"] and confirmed["b_efficiency"] and confirmed["case_coverage"] and confirmed["a_parent_hits"]


def test_replay(spark):
    ranked = spark.createDataFrame([("m", 1, 1, "a", "x" * 30), ("m", 1, 2, "b", "x" * 20), ("m", 1, 3, "c", "x"), ("m", 2, 1, "a", "y" * 99), ("m", 2, 2, "b", "")], "mode string, query_id long, rank int, chunk_id string, text string")
    gold = spark.createDataFrame([(1, "b"), (1, "b"), (2, "z")], "query_id long, chunk_id string")
    got = selection.replay(ranked, gold, 10, "mode").orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [("m", 1, True, False, 3, 1, 1, 30, 51), ("m", 2, False, False, 2, 0, 0, 0, 99)]


def test_all_line_ends(spark):
    text = "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i\nj"
    got = parse.lines(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "document_id long, text string")).where("document_id = 1").orderBy("line_index").collect()
    assert [r["text"] for r in got] == text.splitlines() and [r["start_char"] for r in got] == [2 * i for i in range(10)]


def test_engine_prepares_snapshots(spark, monkeypatch):
    from plinth.plans import engine as engine_module

    monkeypatch.setattr(engine_module, "KEPT", 2)
    chunks = spark.createDataFrame([(f"c{i}", f"word{i % 3} other text {i}") for i in range(20)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "word1"), (2, "other 7"), (3, " ")], "query_id long, query string")
    plain, own = Engine(chunks), Engine(chunks)
    for name in ("a", "b", "a", "c"):
        own.prepare(name)
    assert own.statistics == {"loads": 3, "hits": 1, "invalidations": 1} and set(own._indexes) == {"a", "c"}
    for mode in ("bm25", "lexical"):
        want, got = ([(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in e.search(queries, mode, 5).orderBy("query_id", "rank").collect()] for e in (plain, own))
        assert got == want and len(got) == 10

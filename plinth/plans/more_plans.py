"""Registered queries over page layout, evidence, runs, sessions, snapshots and streams, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions import unicode as U
from plinth.operators import evaluate, evidence, gates, history, pages, parse, represent
from plinth.operators.numbering import numbered
from plinth.plans.engine import Engine, listed
from plinth.plans.search_plans import CASES, MAPPED, RANKED, SUMMARY, _bm25, _metrics, _ranked, cases_of, gold_of, metrics_of, results_of
from plinth.plans.text_plans import CHUNKS, FORMULA, LINES, SECTIONED, blocks_of, chunks_of, lines_of, packed_lines
from plinth.sources import files, generations, paged, providers, snapshots
from plinth.sources.shared import new_folder, sent, stored
from plinth.sources.tables import documents, table, vectors
from plinth.streaming import ingest, sessions


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents on pages of ten lines: 40 points a word, and after every seventh word a gap that splits the line."""
    rows = lines_of(spark, sf_dir).select("document_id", "line_index", F.posexplode(F.split("text", " ")).alias("w", "text")).where("text <> ''")
    x0 = F.col("w") * 40.0 + F.floor(F.col("w") / 7) * 150.0
    return rows.select("document_id", F.floor(F.col("line_index") / 10).cast("int").alias("page"), x0.alias("x0"), (x0 + 30.0).alias("x1"), (F.col("line_index") % 10 * 12.0).alias("top"), "text")


def reading_lines(spark, sf_dir):
    return pages.reading_lines(words_of(spark, sf_dir)).select("document_id", "page", "line_index", "top", "x0", "text")


def column_order(spark, sf_dir):
    return pages.column_order(pages.reading_lines(words_of(spark, sf_dir)), 1000.0).select("document_id", "page", "line_index", "column", "place")


def outside_tables(spark, sf_dir):
    """Lines that don't repeat the pipe lines of their page."""
    rows = lines_of(spark, sf_dir).select("document_id", F.floor(F.col("line_index") / 10).cast("int").alias("page"), "line_index", "text")
    tables = rows.where(F.contains("text", F.lit(" | "))).select("document_id", "page", "text")
    return pages.outside_tables(rows, tables).select("document_id", "line_index")


def heading_lines(spark, sf_dir):
    """What the first lines of every document say about its sections; lines that stand alone between others are no content."""
    scan = represent.heading_scan(F.col("text"), F.lit(None).cast("array<string>"))
    rows = documents(spark, sf_dir).select("document_id", scan.alias("s"))
    return rows.select("document_id", F.array_join("s.local", " | ").alias("local"), F.col("s.holds").alias("holds"))


def formula_evidence(spark, sf_dir):
    """The formulas among a document's lines, beyond doubt and readable."""
    found = F.filter(F.split("text", "\n"), T.formula_line)
    rows = documents(spark, sf_dir).select("document_id", U.formula_evidence(found).alias("f"))
    return rows.where(F.size("f") > 0).select("document_id", F.array_join("f", "\n").alias("formulas"))


#: Lines of a page; pages of a file, which one task reads.
PAGE_LINES, PAGES_OF_FILE = 10, 1 << 11


def captioned_pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents as in ``words_of``, and above the pipe lines of two in three pages a caption; written as compressed page files,
    each page a line, and read by the paged source, each page a row. A page is made within its document's row; only pages of documents
    with one id are shuffled, to meet."""
    docs = documents(spark, sf_dir).select("document_id", "text")
    twice = sent(stored(docs.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id"), "twice"))

    def word(x: Column, w: Column, top: Column) -> Column:
        x0 = w * 40 + F.floor(w / 7) * 150  # whole numbers, which are shorter
        return F.struct(x0.alias("x0"), (x0 + 30).alias("x1"), top.alias("top"), x.alias("text"))

    def pages_of(rows: DataFrame) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE_LINES)), lambda p: F.slice("lines", (p * PAGE_LINES + 1).cast("int"), PAGE_LINES))
        own = rows.select("document_id", parse.line_texts(F.col("text")).alias("lines")).select("document_id", F.posexplode(parts).alias("page", "lines"))
        words = F.transform("lines", lambda line, k: F.filter(F.transform(F.split(line, " "), lambda x, w: word(x, w, k * 12)), lambda x: x["text"] != ""))
        return own.select("document_id", "page", F.flatten(words).alias("words"), F.exists("lines", lambda x: F.contains(x, F.lit(" | "))).alias("piped"))

    joined = pages_of(docs.join(twice, "document_id", "left_semi")).groupBy("document_id", "page").agg(F.flatten(F.collect_list("words")).alias("words"), F.max("piped").alias("piped"))
    rows = pages_of(docs.join(twice, "document_id", "left_anti")).unionByName(joined)
    caption = F.transform(F.array(F.lit("Table"), (F.col("page") + 1).cast("string"), F.lit("lines")), lambda x, w: word(x, w, F.lit(-12)))
    words = F.when(F.col("piped") & (F.col("page") % 3 != 2), F.concat("words", caption)).otherwise(F.col("words"))
    rows = rows.select("document_id", "page", words.alias("words"))
    line = F.when((F.size("words") > 0) & F.col("document_id").isNotNull(), F.to_json(F.struct("document_id", "page", *(F.col(f"words.{c}").alias(c) for c in ("x0", "x1", "top", "text")))))
    folder = new_folder(spark, "pages")
    rows.select(line.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", PAGES_OF_FILE).text(folder)
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged_words").option("path", folder).option("packed", "true").load()


def page_blocks(spark, sf_dir):
    """Blocks of documents as pages of positioned words; pipe lines are the rows of a table, which has a position in every other document."""
    docs = documents(spark, sf_dir)
    lines = docs.select("document_id", parse.line_texts(F.col("text")).alias("lines"))
    rows = docs.where(F.contains("text", F.lit(" | "))).select("document_id", parse.line_texts(F.col("text")).alias("lines")).select("document_id", F.posexplode("lines").alias("line_index", "text")).withColumn("page", F.floor(F.col("line_index") / PAGE_LINES).cast("int"))
    piped = stored(rows.where(F.contains("text", F.lit(" | "))), "piped")
    cells = F.struct("line_index", F.split("text", r" \| ").alias("cells"))
    found = piped.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(cells)).alias("c"), F.min(F.col("line_index") % 10 * 12.0).alias("top"))
    found = found.select("document_id", "page", F.lit(1).alias("table_index"), "top", F.transform("c", lambda x: x["cells"]).alias("rows"))
    tables = pages.page_tables(found.where("document_id % 2 = 0"), found.where("document_id % 2 = 1").drop("top"))
    page = F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE_LINES).cast("int"))).alias("page")
    plain = lines.select("document_id", page).distinct().withColumn("plain_text", F.lit(""))
    parts = pages.parts_of_pages(captioned_pages_of(spark, sf_dir), tables, piped.select("document_id", "page", "text"), plain, 1000.0)
    hashed = parts.select("document_id", "page", "part", "block_type", F.sha2("text", 256).alias("text_sha256"))
    return pages.numbered_parts(hashed).select("document_id", "block_index", "page", "block_type", "text_sha256")


def committed_chunks(spark, sf_dir):
    """Chunks written as a generation by the committing source, and read back by its manifest."""
    folder, chunks = new_folder(spark, "generations"), chunks_of(spark, sf_dir)
    generations.write(chunks.select("chunk_id", "document_id", "text"), folder, "chunk_id")
    return generations.read(spark, folder).select("chunk_id", "document_id", F.sha2("text", 256).alias("text_sha256"))


def page_tables(spark, sf_dir):
    """Pipe lines as the tables of pages, positioned in every other document."""
    rows = lines_of(spark, sf_dir).withColumn("page", F.floor(F.col("line_index") / 10).cast("int")).where(F.contains("text", F.lit(" | ")))
    cells = F.struct("line_index", F.split("text", r" \| ").alias("cells"))
    found = rows.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(cells)).alias("c"), F.min("line_index").cast("double").alias("top"))
    found = found.select("document_id", "page", F.lit(1).alias("table_index"), "top", F.transform("c", lambda x: x["cells"]).alias("rows"))
    shown = pages.page_tables(found.where("document_id % 2 = 0"), found.drop("top"))
    return shown.select("document_id", "page", "top", F.sha2("text", 256).alias("text_sha256"), "malformed")


def evidence_spans(spark, sf_dir):
    return evidence.build_spans(blocks_of(spark, sf_dir))


def source_match_kinds(spark, sf_dir):
    """How each result's path matches the paths of its query's gold chunks, by the file's name."""
    chunks = chunks_of(spark, sf_dir).select("chunk_id", "source_path", F.col("document_id").cast("string").alias("file"))
    gold = gold_of(spark, sf_dir).join(chunks, "chunk_id").select("query_id", F.col("file").alias("expected")).distinct()
    rows = results_of(spark, sf_dir, "bm25").join(chunks, "chunk_id").join(gold, "query_id")
    return rows.groupBy("query_id", evidence.path_match(F.col("source_path"), F.col("expected")).alias("kind")).agg(F.count("*").alias("n"))


def folded_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.size(U.folded_tokens("text")).alias("n_tokens"))


def release_gates(spark, sf_dir):
    """BM25 at 5 against limits."""
    row = evaluate.summary(metrics_of(spark, sf_dir, "bm25", 5))
    found = gates.gates(row, {"recall": (">=", 0.3), "mrr": (">=", 0.3), "ndcg": (">=", 0.3), "precision": (">=", 0.5), "n_cases": ("<=", 1000.0)})
    return found.withColumn("value", F.round("value", 6))


def trial_latency(spark, sf_dir):
    """Event values as latencies of three trials for each type."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("trial"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"))
    return gates.cold_and_warm(rows, "event_type").select("event_type", *(F.round(c, 6).alias(c) for c in ("cold_ms", "warm_ms", "warm_p50", "warm_p95")))


def trial_consensus(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    return gates.consensus(rows.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("trial"), (F.col("m") > 50).alias("hit")))


def session_list(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 40), "turn").alias("title"))
    updated = F.timestamp_micros(F.col("n") * 1_000_000)
    rows = rows.select(F.col("conv_id").alias("session_id"), "title", (F.col("conv_id") % 10 == 0).alias("pinned"), (F.col("conv_id") % 7 == 0).alias("starred"), updated.alias("updated_at"))
    return history.listed(rows).select("session_id", "place")


def case_numbers(spark, sf_dir):
    """Evaluation cases with ids in the order of their passages."""
    rows = numbered(table(spark, sf_dir, "benchmark"), "text", "item_id")
    return rows.select("item_id", F.format_string("synthetic-span-%06d", F.col("number") + 1).alias("case_id"))


def snapshot_chunks(spark, sf_dir):
    """All chunks, written as a generation and read back through its pointer."""
    folder = new_folder(spark, "snapshots")
    snapshots.commit(folder, chunks_of(spark, sf_dir))
    return snapshots.read(spark, folder).select("chunk_id", "schema_version", F.length("text").alias("n_chars"))


def snapshot_vectors(spark, sf_dir):
    """Documents as a generation, their vectors as its child, read back through the pointer, with what the manifest says."""
    folder = new_folder(spark, "snapshots")
    chunks = documents(spark, sf_dir).select(F.col("document_id").cast("string").alias("chunk_id"), "text")
    first = snapshots.commit(folder, chunks)
    index = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("raw_chunk_text_v1").alias("representation"))
    snapshots.child(spark, folder, index.join(chunks, "chunk_id", "left_semi"))
    row = snapshots.active(spark, folder)
    same = F.lit(row["parent_snapshot_id"] == first)
    facts = snapshots.manifest_of(spark, folder)
    return snapshots.read(spark, folder, "vectors").select("chunk_id", F.size("embedding").alias("n"), F.lit(int(facts["dimensions"])).alias("dimensions"), F.lit(snapshots.status(spark, folder)).alias("status"), same.alias("of_first"))


def snapshot_migration(spark, sf_dir):
    """Chunks of older layouts as a first generation."""
    folder = new_folder(spark, "snapshots")
    version = F.when(F.col("document_id") % 3 > 0, (F.col("document_id") % 3).cast("int"))
    legacy = chunks_of(spark, sf_dir).select("chunk_id", "text", version.alias("schema_version"))
    found = snapshots.migrate(folder, legacy)["versions"]
    before = F.create_map(*(F.lit(x) for pair in found.items() for x in pair))
    rows = snapshots.read(spark, folder).groupBy("schema_version").agg(F.count("*").alias("n"))
    return rows.select("schema_version", "n", *(before[v].alias(f"n_{v}") for v in (0, 1, 2)))


def folder_lines(spark, sf_dir):
    """Passages, written as text files into folders below one another, found again and read; other files are skipped."""
    folder = new_folder(spark, "files")
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"), (F.col("item_id") % 3).alias("part"))
    rows.repartition("part").write.partitionBy("part").text(f"{folder}/texts")
    rows.select("part").coalesce(1).write.json(f"{folder}/other")
    texts, skipped = files.read_documents(spark, folder)
    lines = texts.select(F.regexp_extract("source_path", "part=([0-9])/", 1).cast("int").alias("part"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    n = skipped.where(F.col("relative_path").rlike("json$")).agg((F.count("*") > 0).alias("skipped"))
    return lines.groupBy("part").agg(F.count("*").alias("n_lines"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("lines_sha256")).join(F.broadcast(n))


def asked(spark, sf_dir):
    """Answers to passages as questions, by a stand-in for a service that answers two of three; a third of the passages is blank."""
    cases = cases_of(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, "  ").otherwise(F.col("query")))

    def generate(prompts: DataFrame) -> DataFrame:
        return prompts.where("query_id % 3 = 1").select("query_id", F.concat(F.lit("answer to "), F.col("query_id").cast("string")).alias("answer"))

    return Engine(chunks_of(spark, sf_dir)).ask(cases, generate, "bm25").select("query_id", "status", "answer")


def engine_compare(spark, sf_dir):
    """Two modes at two limits through the engine, and one that has no index."""
    engine = Engine(chunks_of(spark, sf_dir)).keep("now")
    rows = engine.compare(cases_of(spark, sf_dir), stored(gold_of(spark, sf_dir), "gold"), listed("bm25, lexical,semantic,bm25"), [1, 5], fail_fast=False)
    return rows.select("mode", "k", "n_cases", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"), F.col("error").isNotNull().alias("failed"))


def hash_embeddings(spark, sf_dir):
    """Vectors of all chunks by the offline provider, and how long each is."""
    made = providers.embed(chunks_of(spark, sf_dir), providers.hashing_provider())
    return made.select("chunk_id", "text_hash", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def engine_search(spark, sf_dir):
    """Hybrid search over chunks with vectors of the offline provider."""
    provider = providers.hashing_provider()
    chunks = chunks_of(spark, sf_dir)

    def embed(queries: DataFrame) -> DataFrame:
        made = providers.embed(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), provider)
        return made.select(F.col("chunk_id").alias("query_id"), "embedding")

    engine = Engine(chunks, lambda rows: providers.embed(rows, provider).select("chunk_id", "embedding"), embed)
    return engine.search(cases_of(spark, sf_dir), "hybrid", 10).withColumn("score", F.round("score", 9))


def all_modes_compare(spark, sf_dir):
    """All four modes at two limits, with vectors of the offline provider, and one that there isn't as a row with its error."""
    provider, chunks = providers.hashing_provider(), stored(chunks_of(spark, sf_dir), "chunks")

    def embed(queries: DataFrame) -> DataFrame:
        made = providers.embed(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), provider)
        return made.select(F.col("chunk_id").alias("query_id"), "embedding")

    index = stored(providers.embed(chunks, provider).select("chunk_id", "embedding"), "index")
    engine = Engine(chunks, index, embed)
    rows = engine.compare(cases_of(spark, sf_dir), stored(gold_of(spark, sf_dir), "gold"), ["bm25", "lexical", "semantic", "hybrid", "telepathic"], [1, 5], fail_fast=False)
    return rows.select("mode", "k", "n_cases", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"), F.col("error").isNotNull().alias("failed"))


def stream_chunks(spark, sf_dir):
    return ingest.stream_chunks(spark, f"{sf_dir}/documents.parquet", new_folder(spark, "stream")).select("chunk_id", F.sha2("text", 256).alias("text_hash"))


def stream_sessions(spark, sf_dir):
    """Summaries of conversations by a stream of their turns, whose state is kept."""
    folder = new_folder(spark, "sessions")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.lit("turn").alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns.where("turn < 2").write.parquet(f"{folder}/events/first")
    events = spark.readStream.schema(sessions.EVENT).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
    sessions.run(spark, events, folder)
    turns.where("turn >= 2").write.parquet(f"{folder}/events/later")
    return sessions.run(spark, events, folder)


def stream_windows(spark, sf_dir):
    rows = ingest.stream_windows(spark, f"{sf_dir}/events.parquet", new_folder(spark, "stream"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        reading_lines, column_order, outside_tables, page_tables, page_blocks, heading_lines, formula_evidence, evidence_spans, source_match_kinds, folded_tokens, release_gates, trial_latency,
        trial_consensus, session_list, case_numbers, snapshot_chunks, snapshot_vectors, snapshot_migration, folder_lines, asked, engine_compare, hash_embeddings, engine_search, all_modes_compare, stream_chunks, stream_windows, stream_sessions, committed_chunks,
    )
}

PIECES = LINES + (
    ", ws as (select document_id, (line_index // 10)::int page, line_index, string_split(line, ' ') w from lines)"
    ", pc as (select document_id, page, line_index, k, list_filter(w[7 * k + 1:7 * k + 7], lambda x: x <> '') p, list_position(list_transform(w[7 * k + 1:7 * k + 7], lambda x: x <> ''), true) o"
    " from (select *, unnest(range(0, (len(w) + 6) // 7)) k from ws))"
    ", pieces as (select document_id, page, (row_number() over (partition by document_id, page order by line_index, k) - 1)::int line_index, (line_index % 10 * 12.0)::double top,"
    " ((7 * k + o - 1) * 40.0 + k * 150.0)::double x0, array_to_string(p, ' ') t from pc where len(p) > 0)"
)


def _title(x: str) -> str:
    """SQL for a line that looks like a title."""
    words = f"regexp_extract_all({x}, '[A-Za-z]+')"
    small, library = ("(" + ", ".join(f"'{w}'" for w in ws) + ")" for ws in (represent.SMALL_WORDS, represent.LIBRARY_WORDS))
    telling = f"list_filter({words}, lambda w: lower(w) not in {small})"
    return (
        f"(length({x}) <= 120 and not regexp_matches({x}, '[.?!:;]$') and not contains({x}, ',') and not regexp_matches({x}, '{represent.MATH_NOISE}') and len({words}) between 3 and 14 and len({telling}) >= 2"
        f" and len(list_filter({telling}, lambda w: lower(w) in {library})) = 0 and len(list_filter({telling}, lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.6 * len({telling}))"
    )


LED, NUMBERED = f"trim(regexp_extract(l, '{represent.LED}', 1))", (f"regexp_extract(l, '{represent.NUMBERED}', 1)", f"trim(regexp_extract(l, '{represent.NUMBERED}', 2))")
HEADING = f"""case when regexp_matches(l, '{represent.NUMBER}') then case when i <= 3 and nx is not null and {_title("nx")} then 'h' || nx end
  when regexp_matches(l, '{represent.STRUCTURAL}') then 'h' || l when regexp_matches(l, '{represent.LOCAL}') then 'l' || l
  when i <= 3 and {LED} <> '' and (regexp_matches({LED}, '{represent.STRUCTURAL}') or {_title(LED)}) then 'h' || {LED}
  when {NUMBERED[0]} = '' then case when i <= 3 and {_title("l")} then 'h' || l end
  when regexp_matches({NUMBERED[1]}, '{represent.MATH_NOISE}') then null when regexp_matches({NUMBERED[1]}, '{represent.LOCAL}') then 'l' || {NUMBERED[0]} || ' ' || {NUMBERED[1]}
  when {_title(NUMBERED[1])} then 'h' || {NUMBERED[0]} || ' ' || {NUMBERED[1]}
  when len(regexp_extract_all({NUMBERED[1]}, '[A-Za-z]+')) >= 2 and not regexp_matches({NUMBERED[1]}, '[.?!]$') then 'l' || {NUMBERED[0]} || ' ' || {NUMBERED[1]} end"""
#: Signed, hashed words of texts (key, text) as unit vectors, a row for each dimension that isn't 0; crc32 is folded over a word's bytes.
HASHED = """, {p}w as (select key, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '')) word from {source})
  , {p}h as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::bigint) h from (select distinct word from {p}w))
  , {p}s as (select key, h % 64 d, sum(case when h >> 31 = 1 then 1 else -1 end)::double v from {p}w join {p}h using (word) group by key, d having v <> 0)
  , {p}e as (select key, d, v / sqrt(sum(v * v) over (partition by key)) v from {p}s)"""
COLUMNS = """g as (select document_id, page, x0 - lag(x0) over (partition by document_id, page order by x0) gap, x0 from {p})
  , m as (select document_id, page, max_by(gap, (gap, -x0)) gap, max_by(x0 - gap / 2, (gap, -x0)) mid from g where gap is not null group by document_id, page)
  , s as (select p.*, gap, mid, coalesce(x0 > mid, false) r from {p} p left join m using (document_id, page))
  , c as (select *, case when r and coalesce(gap >= 120 and mid between 200 and 800 and count(*) filter (where r) over w >= 2 and count(*) filter (where not r) over w >= 2, false) then 1 else 0 end col
    from s window w as (partition by document_id, page))"""
WORDS_OF = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
BLOCKS_OF_PAGES = rf"""{PIECES}, tl as (select document_id, (line_index // 10)::int page, line_index, line from lines where contains(line, ' | '))
  , p2 as (select document_id, page, row_number() over (partition by document_id, page order by top, x0) - 1 line_index, top, x0, t from (
    select document_id, page, top, x0, t from pieces union all select distinct document_id, page, -12.0, 0.0, 'Table ' || (page + 1) || ' lines' from tl where page % 3 <> 2))
  , {COLUMNS.format(p="p2")}
  , o as (select document_id, page, row_number() over (partition by document_id, page order by col, top, x0) - 1 li, t, lower(trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) norm from c)
  , e as (select *, case when row_number() over (partition by document_id, page order by li) <= 2 then 'header' when row_number() over (partition by document_id, page order by li desc) <= 2 then 'footer' end place from o)
  , v as (select document_id, norm, case when 2 * count(*) filter (where place = 'header') > count(*) then 'header' when 2 * count(*) filter (where place = 'header') < count(*) then 'footer' else min_by(place, (page, li)) end side from e
    where place is not null and length(norm) between 1 and 80 and len(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+(?:@[\p{{L}}\p{{N}}_]+)?')) between 1 and 8
      and document_id in (select document_id from o group by document_id having min(page) < max(page)) group by document_id, norm having count(*) >= 2)
  , k as (select document_id, page, li, t, {WORDS_OF.format("t")} w from e left join v using (document_id, norm) where not coalesce(side = place, false))
  , h as (select document_id, page, list_distinct(flatten(list(w))) h, list(w) ws from (select document_id, page, {WORDS_OF.format("line")} w from tl) group by document_id, page)
  , body as (select document_id, page, string_agg(t, chr(10) order by li) t from k left join h using (document_id, page)
    where not coalesce(len(w) >= 2 and (len(list_intersect(w, h)) >= 2 and len(list_intersect(w, h)) >= 0.8 * len(w)
      or len(list_filter(ws, lambda x: len(x) >= 2 and len(list_intersect(w, x)) >= 2 and len(list_intersect(w, x)) >= 0.8 * len(w) and len(list_intersect(w, x)) >= 0.8 * len(x))) > 0), false)
    group by document_id, page having trim(string_agg(t, chr(10) order by li)) <> '')
  , tr as (select document_id, page, line_index, list_transform(string_split(line, ' | '), lambda x: replace(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')), '|', '\|')) c from tl)
  , tp as (select document_id, page, min(line_index % 10 * 12.0) top from tr group by document_id, page)
  , tk as (select *, row_number() over (partition by document_id, page order by line_index) n, max(len(c)) over (partition by document_id, page) w from tr where len(list_filter(c, lambda x: x <> '')) > 0)
  , ts as (select document_id, page, n, w, list_concat(c, list_transform(range(w - len(c)), lambda i: '')) c from tk)
  , tt as (select document_id, page, string_agg('| ' || array_to_string(case when n = 1 then list_transform(c, lambda x, i: case when x = '' then 'Column ' || i else x end) else c end, ' | ') || ' |'
      || case when n = 1 then chr(10) || '|' || repeat('---|', w) else '' end, chr(10) order by n) t from ts group by document_id, page)
  , cp as (select document_id, page, case when document_id % 2 = 0 then max_by(p2.t, (p2.top, -line_index)) filter (where p2.top < tp.top) else min_by(p2.t, line_index) end cap
    from p2 join tp using (document_id, page) where regexp_matches(p2.t, '(?i)^\s*(table\s+[0-9]+[:.]?|table\s+[ivxlcdm]+[:.]?|表\s*[0-9]+[:.]?).') group by document_id, page)
  , bl as (select document_id, page, 0 part, 'paragraph' block_type, t from body union all
    select document_id, page, 1, 'table', coalesce(cap || chr(10) || chr(10), '') || t from tt left join cp using (document_id, page))"""
SQL = {
    "page_blocks": f"with {BLOCKS_OF_PAGES} select document_id, (row_number() over (partition by document_id order by page, part) - 1)::int block_index, page, block_type, sha256(t) text_sha256 from bl",
    "cleaned_text": f"""with {SECTIONED}, k as (select *, document_id % 2 = 0 pdf from sectioned where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
      , ls as (select chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '(?i)\\(cid:[0-9]+\\)', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') l from k where pdf)
      , li as (select chunk_id, unnest(l) l, unnest(range(1, len(l) + 1)) i, unnest(list_append(l[2:], null)) nx from ls)
      , hd as (select *, {HEADING} h from li where i <= 40), hs as (select chunk_id, i, substr(h, 1, 1) = 'h' holds, substr(h, 2) h from hd where h is not null)
      , fs as (select *, row_number() over (partition by chunk_id, lower(h) order by i) = 1 fresh from hs)
      , sc as (select *, coalesce(sum(fresh::int) over (partition by chunk_id order by i rows between unbounded preceding and 1 preceding), 0) < 3 seen from fs)
      , ag as (select chunk_id, string_agg(h, ' | ' order by i) filter (where fresh) "local", max_by(h, i) filter (where holds) holds from sc where seen group by chunk_id)
      , fl as (select chunk_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_index from k where pdf)
      , f as (select chunk_id, line_index, trim(regexp_replace(regexp_replace(replace(replace(line, '−', '-'), '–', '-'), '(?i)\\(cid:[0-9]+\\)', '', 'g'), '\\s+', ' ', 'g')) x from fl where {FORMULA})
      , c as (select *, row_number() over (partition by chunk_id, lower(x) order by line_index) d from f where length(x) between 4 and 240 and regexp_matches(x, '\\p{{L}}') and regexp_matches(x, '(?i)\\d|\\b(?:pi|lambda|integral|sum|sqrt)\\b')
        and (regexp_matches(x, '(?i)\\b(?:RRF|MRR|Recall@|Hit@|nDCG@|Precision@)') or regexp_matches(x, '(?i)=|<|>|\\^|\\|\\||\\b(?:approx|integral|sum|sqrt|element_of|subset_of|orthogonal_to|norm)\\b')))
      , n as (select *, row_number() over (partition by chunk_id order by line_index) n from c where d = 1), fe as (select chunk_id, string_agg(x, ' | ' order by n) x from n where n <= 3 group by chunk_id)
      , w as (select k.*, coalesce(nullif(ag."local", ''), last_value(case when pdf then ag.holds end ignore nulls) over (partition by document_id order by chunk_index rows between unbounded preceding and 1 preceding)) own, fe.x,
          trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(text, chr(173), ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))),
            lambda x: not regexp_matches(x, '{represent.NUMBER}')), chr(10)), '(?i)\\(cid:[0-9]+\\)', '', 'g'), '([A-Za-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g'), '\\s+', ' ', 'g')) clean
        from k left join ag using (chunk_id) left join fe using (chunk_id))
      , r as (select chunk_id, 'Document title: ' || case when document_id % 3 = 0 then 'Document ' || document_id else document_id::varchar end || chr(10) || 'Source: ' || source_path || chr(10)
          || 'Section: ' || case when pdf then coalesce(own, 'unknown') else 'unknown' end || chr(10) || 'Page: ' || case when start_char // 3000 = (end_char - 1) // 3000 then (start_char // 3000 + 1)::varchar
            else (start_char // 3000 + 1) || '-' || ((end_char - 1) // 3000 + 1) end || chr(10) || 'Block types: ' || case when contains(text, ' | ') then 'paragraph, table' else 'paragraph' end || chr(10)
          || 'Signals: ' || case when contains(text, '=') and contains(text, ' | ') then 'formula, table' when contains(text, '=') then 'formula' when contains(text, ' | ') then 'table' else 'none' end || chr(10)
          || case when pdf then 'Formula evidence: ' || coalesce(x, 'none') || chr(10) || 'Content:' || chr(10) || clean else 'Content:' || chr(10) || text end r from w)
      select chunk_id, sha256(r) representation_sha256, length(r)::int n_chars from r""",
    "hash_embeddings": f"""with {CHUNKS}{HASHED.format(p="c", source="(select chunk_id key, text from chunks)")}, n as (select key chunk_id, sum(v * v) x from ce group by key)
      select chunk_id, sha256(text) text_hash, 64 n, round(coalesce(x, 0), 6) norm from chunks left join n using (chunk_id)""",
    "engine_search": f"""with {CHUNKS}, {CASES}, {_bm25("chunks", 40)}{HASHED.format(p="c", source="(select chunk_id key, text from chunks)")}{HASHED.format(p="q", source="(select query_id key, query as text from cases)")}
      , near as (select qe.key query_id, ce.key chunk_id, sum(qe.v * ce.v) score from qe join ce using (d) group by all), {_ranked("near", "dense", 40)}
      , f as (select query_id, chunk_id, b.rank a, d.rank z, coalesce(1.0::double / (60 + b.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0) score from bm25 b full join dense d using (query_id, chunk_id))
      , r as (select *, (row_number() over (partition by query_id order by round(score, 12) desc, least(a, z), chunk_id))::int rank from f) select query_id, rank, chunk_id, round(score, 9) score from r where rank <= 10""",
    "all_modes_compare": f"""with {CHUNKS}, {CASES}, {MAPPED}, {_bm25("chunks", 20)}{HASHED.format(p="c", source="(select chunk_id key, text from chunks)")}{HASHED.format(p="q", source="(select query_id key, query as text from cases)")}
      , near as (select qe.key query_id, ce.key chunk_id, sum(qe.v * ce.v) score from qe join ce using (d) group by all), {_ranked("near", "semantic", 20)}
      , f as (select query_id, chunk_id, b.rank a, d.rank z, coalesce(1.0::double / (60 + b.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0) score from bm25 b full join semantic d using (query_id, chunk_id))
      , hybrid as (select *, (row_number() over (partition by query_id order by round(score, 12) desc, least(a, z), chunk_id))::int rank from f), """
    + ", ".join(_metrics(m, k, f"{m}{k}") for m in ("lexical", "bm25", "semantic", "hybrid") for k in (1, 5))
    + " "
    + " union all ".join(f"select '{m}' \"mode\", {k} k, n_cases, hit_rate, mrr, false failed from (select {SUMMARY} from {m}{k})" for m in ("lexical", "bm25", "semantic", "hybrid") for k in (1, 5))
    + " union all select 'telepathic', unnest([1, 5]), null, null, null, true",
    "committed_chunks": f"with {CHUNKS} select chunk_id, document_id, sha256(text) text_sha256 from chunks",
    "reading_lines": f'with {PIECES} select document_id, page, line_index, top, x0, t as "text" from pieces',
    "column_order": f"""with {PIECES}, {COLUMNS.format(p="pieces")}
      select document_id, page, line_index, col "column", (row_number() over (partition by document_id, page order by col, top, x0) - 1)::int place from c""",
    "outside_tables": f"""with {LINES}, r as (select document_id, line_index // 10 page, line_index, line, list_distinct(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+')) w from lines)
      , h as (select document_id, page, list_distinct(flatten(list(w))) h, list(w) ws from r where contains(line, ' | ') group by document_id, page)
      select document_id, line_index from r left join h using (document_id, page)
      where not coalesce(len(w) >= 2 and (len(list_intersect(w, h)) >= 2 and len(list_intersect(w, h)) >= 0.8 * len(w)
        or len(list_filter(ws, lambda x: len(x) >= 2 and len(list_intersect(w, x)) >= 2 and len(list_intersect(w, x)) >= 0.8 * len(w) and len(list_intersect(w, x)) >= 0.8 * len(x))) > 0), false)""",
    "page_tables": f"""with {LINES}, r as (select document_id, line_index // 10 page, line_index, list_transform(string_split(line, ' | '),
        lambda x: replace(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '|', '\\|')) c from lines where contains(line, ' | ')
      ), f as (select document_id, page, min(line_index) top from r group by document_id, page
      ), k as (select *, row_number() over (partition by document_id, page order by line_index) n, max(len(c)) over (partition by document_id, page) w, min(len(c)) over (partition by document_id, page) v
        from r where len(list_filter(c, lambda x: x <> '')) > 0
      ), s as (select document_id, page, n, w, v, list_concat(c, list_transform(range(w - len(c)), lambda i: '')) c from k
      ), o as (select document_id, page, any_value(v < w) malformed, string_agg('| ' || array_to_string(case when n = 1 then list_transform(c, lambda x, i: case when x = '' then 'Column ' || i else x end) else c end, ' | ') || ' |'
        || case when n = 1 then chr(10) || '|' || repeat('---|', w) else '' end, chr(10) order by n) t from s group by document_id, page)
      select document_id, page::int page, case when document_id % 2 = 0 then top end::double top, sha256(t) text_sha256, malformed from o join f using (document_id, page)""",
    "heading_lines": f"""with docs as (select doc_id document_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') t from documents)
      , ls as (select document_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '(?i)\\(cid:[0-9]+\\)', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') l from docs)
      , li as (select document_id, unnest(l) l, unnest(range(1, len(l) + 1)) i, unnest(list_append(l[2:], null)) nx from ls)
      , hd as (select *, {HEADING} h from li where i <= 40), hs as (select document_id, i, substr(h, 1, 1) = 'h' holds, substr(h, 2) h from hd where h is not null)
      , fs as (select *, row_number() over (partition by document_id, lower(h) order by i) = 1 fresh from hs)
      , sc as (select *, coalesce(sum(fresh::int) over (partition by document_id order by i rows between unbounded preceding and 1 preceding), 0) < 3 seen from fs)
      , ag as (select document_id, string_agg(h, ' | ' order by i) filter (where fresh) "local", max_by(h, i) filter (where holds) holds from sc where seen group by document_id)
      select document_id, coalesce("local", '') "local", holds from docs left join ag using (document_id)""",
    "formula_evidence": f"""with {LINES}, f as (select document_id, line_index, trim(regexp_replace(regexp_replace(replace(replace(line, '−', '-'), '–', '-'), '(?i)\\(cid:[0-9]+\\)', '', 'g'), '\\s+', ' ', 'g')) x from lines where {FORMULA})
      , c as (select *, row_number() over (partition by document_id, lower(x) order by line_index) d from f where length(x) between 4 and 240 and regexp_matches(x, '\\p{{L}}') and regexp_matches(x, '(?i)\\d|\\b(?:pi|lambda|integral|sum|sqrt)\\b')
        and (regexp_matches(x, '(?i)\\b(?:RRF|MRR|Recall@|Hit@|nDCG@|Precision@)') or regexp_matches(x, '(?i)=|<|>|\\^|\\|\\||\\b(?:approx|integral|sum|sqrt|element_of|subset_of|orthogonal_to|norm)\\b')))
      , n as (select *, row_number() over (partition by document_id order by line_index) n from c where d = 1)
      select document_id, string_agg(x, chr(10) order by n) formulas from n where n <= 3 group by document_id""",
    "evidence_spans": f"""with recursive {packed_lines(1200, False)}, b as (select *, substr(t, 1, 1200) p, length(t) <= 1200 w, cnt = 1 and tab alone from ck)
      , v as (select *, length(p) - length(regexp_extract(p, '[^ ]*$')) - 1 z from b), x as (select *, case when alone or w then t when z >= 600 then substr(p, 1, z) else p end y from v)
      , k as (select *, row_number() over (partition by document_id order by c) - 1 i from x where length(y) >= 250 or alone)
      select document_id || '::span-' || lpad(i::varchar, greatest(4, length(i::varchar))::int, '0') span_id, document_id, s::int start_char, (case when w or alone then e else s + length(y) end)::int end_char, sha256(y) text_sha256, length(y)::int n_chars from k""",
    "folded_tokens": f"with docs as (select doc_id document_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') t from documents) select document_id, len(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'))::int n_tokens from docs",
    "source_match_kinds": f"""with {RANKED}, {MAPPED}, g as (select distinct query_id, document_id d from gold join chunks using (chunk_id))
      select query_id, case when source_path = d::varchar then 'exact' when ends_with(source_path, '/' || d) then 'suffix' else 'none' end kind, count(*) n
      from bm25 join chunks using (chunk_id) join g using (query_id) group by all""",
    "release_gates": f"""with {RANKED}, {MAPPED}, {_metrics("bm25", 5, "m")}, s as (select {SUMMARY} from m)
      select gate, round(v, 6) "value", l "limit", case when gate = 'n_cases' then v <= l else v >= l end passed from (
        select 'recall' gate, recall v, 0.3::double l from s union all select 'mrr', mrr, 0.3 from s union all select 'ndcg', ndcg, 0.3 from s
        union all select 'precision', "precision", 0.5 from s union all select 'n_cases', n_cases, 1000 from s)""",
    "trial_latency": """with r as (select event_type, value v, row_number() over (partition by event_type, user_id % 3 order by event_id) = 1 c from events)
      select event_type, round(avg(v) filter (where c), 6) cold_ms, round(avg(v) filter (where not c), 6) warm_ms, round(quantile_cont(v, 0.5) filter (where not c), 6) warm_p50,
        round(quantile_cont(v, 0.95) filter (where not c), 6) warm_p95 from r group by event_type""",
    "trial_consensus": """with m as (select user_id, event_type, max(value) > 50 hit from events group by all)
      select user_id query_id, count(*) filter (where hit) n_hits, count(*) n_trials, count(*) filter (where hit) >= 2 agreed from m group by user_id""",
    "session_list": """with s as (select conv_id, count(*) n, min_by(substr(text, 1, 40), turn) title from conversations group by conv_id)
      select conv_id session_id, row_number() over (order by conv_id % 10 <> 0, conv_id % 7 <> 0, n desc, lower(title), conv_id) - 1 place from s""",
    "case_numbers": "select item_id, 'synthetic-span-' || lpad((row_number() over (order by text, item_id))::varchar, 6, '0') case_id from benchmark",
    "snapshot_chunks": f"with {CHUNKS} select chunk_id, 2 schema_version, length(text)::int n_chars from chunks",
    "snapshot_vectors": "select vec_id::varchar chunk_id, len(embedding)::int n, (select max(len(embedding)) from embeddings)::int dimensions, 'ready' status, true of_first from embeddings where vec_id in (select doc_id from documents)",
    "snapshot_migration": f"""with {CHUNKS} select 2 schema_version, count(*) n, count(*) filter (where document_id % 3 = 0) n_0, count(*) filter (where document_id % 3 = 1) n_1, count(*) filter (where document_id % 3 = 2) n_2 from chunks""",
    "folder_lines": """with l as (select (item_id % 3)::int part, unnest(string_split(text, chr(10))) line from benchmark)
      select part, count(*) n_lines, sha256(string_agg(line, chr(10) order by line)) lines_sha256, true skipped from l where line <> '' group by part""",
    "asked": f"""with {RANKED} select query_id, case when query_id % 3 = 0 or query_id not in (select query_id from bm25) then 'skipped' when query_id % 3 = 1 then 'success' else 'failed' end status,
      case when query_id % 3 = 1 and query_id in (select query_id from bm25) then 'answer to ' || query_id end answer from cases""",
    "engine_compare": f"with {RANKED}, {MAPPED}, "
    + ", ".join(_metrics(m, k, f"{m}{k}") for m in ("lexical", "bm25") for k in (1, 5))
    + " "
    + " union all ".join(f"select '{m}' \"mode\", {k} k, n_cases, hit_rate, mrr, false failed from (select {SUMMARY} from {m}{k})" for m in ("lexical", "bm25") for k in (1, 5))
    + " union all select 'semantic', unnest([1, 5]), null, null, null, true",
    "stream_chunks": f"with {CHUNKS} select chunk_id, sha256(text) text_hash from chunks",
    "stream_sessions": """select conv_id session_id, count(*) n_turns, count(*) filter (where role = 'user') n_user, sum(length(text))::bigint n_chars, min_by(substr(text, 1, 40), turn) filter (where role = 'user') title
      from conversations group by conv_id""",
    "stream_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all",
}

"""Registered queries over documents, lines, chunks and pages, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import chunking, evidence, parse, represent
from plinth.sources import files
from plinth.sources.tables import documents, table

DOCS = "docs as (select doc_id document_id, source || '/' || doc_id source_path, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') t, lang, source from documents)"
LINES = DOCS + ", l0 as (select document_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) line_index from docs)"
LINES += (
    ", lines as (select document_id, line_index::int line_index, (coalesce(sum(length(line) + 1) over (partition by document_id order by line_index"
    " rows between unbounded preceding and 1 preceding), 0))::int start_char, line from l0)"
)
CHUNK_ID = "source_path || '::chunk-' || lpad(chunk_index::varchar, greatest(4, length(chunk_index::varchar))::int, '0')"
CHUNKS = DOCS + (
    ", c0 as (select document_id, source_path, t, unnest(range(0, length(t), 900)) start_char from docs), chunks as ("
    "select {id} chunk_id, document_id, source_path, chunk_index, start_char, start_char + length(text) end_char, text from ("
    "select *, (start_char / 900)::int chunk_index, substr(t, start_char + 1, 1000) text from c0))"
).replace("{id}", CHUNK_ID)


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sliding_chunks(documents(spark, sf_dir))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.lines(documents(spark, sf_dir))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a block: a table row where it has pipes, else a paragraph."""
    kind = F.when(F.contains("text", F.lit(" | ")), "table").otherwise("paragraph")
    rows = lines_of(spark, sf_dir).withColumn("block_type", kind)
    return rows.select("document_id", F.col("line_index").alias("block_index"), "block_type", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages of ten lines."""
    rows = lines_of(spark, sf_dir)
    return rows.select("document_id", F.floor(F.col("line_index") / 10).cast("int").alias("page"), "line_index", "text")


def markdown_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown: headings, list items and paragraphs, each between empty lines."""
    html = F.regexp_replace("html", r"(?is)<(script|style|head)[^>]*>.*?</\1>|<!--.*?-->", "")
    for tag, mark in (("h1", "# "), ("h2", "## "), ("h3", "### "), ("li", "- ")):
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>", "\n\n" + mark)
    html = F.regexp_replace(F.regexp_replace(html, r"(?is)</?(p|div|article|nav|ul|ol|br|h[1-6]|li)[^>]*>", "\n\n"), r"<[^>]*>", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), html.alias("text"))


def line_offsets(spark, sf_dir):
    return lines_of(spark, sf_dir)


def text_blocks(spark, sf_dir):
    return parse.text_blocks(documents(spark, sf_dir))


def sliding_chunks(spark, sf_dir):
    return chunks_of(spark, sf_dir)


def split_oversized(spark, sf_dir):
    return chunking.split_oversized(documents(spark, sf_dir))


def packed_in_parallel(spark, sf_dir):
    """As block_chunks, every document packed the way that fits the largest."""
    rows = chunking.block_chunks_of_any_size(blocks_of(spark, sf_dir), 400, 50, large=0)
    return rows.select("document_id", "chunk_index", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"), "start_char", "end_char", F.array_join("block_types", ",").alias("block_types"), "exceeds")


def block_metadata(spark, sf_dir):
    """What the blocks of a chunk say together: pages of ten lines, the first line that begins with a capital as a heading, formulas, warnings."""
    page, capital = F.floor(F.col("block_index") / 10).cast("int"), F.col("text").rlike("^[A-Z]")
    rows = blocks_of(spark, sf_dir).withColumns({
        "page_number": page, "heading_path": F.when(capital, F.array(F.substring("text", 1, 12))).otherwise(F.array().cast("array<string>")), "level": (F.length("text") % 2).cast("int"),
        "media_type": F.when(F.col("block_index") % 3 == 1, "").otherwise("text/plain"), "formula_lines": F.when(T.formula_line(F.col("text")), F.array("text")), "removed_lines": (F.length("text") % 3).cast("int"),
        "warnings": F.when(F.col("block_index") % 4 == 0, F.array(F.concat(F.lit("line "), F.col("block_index").cast("string")))),
    })
    found = chunking.block_chunks(rows, 1200, split=False)
    return found.select("document_id", "chunk_index", "page_start", "page_end", F.array_join("heading_path", "/").alias("heading"), "level", "media_type", F.size("formula_lines").alias("n_formulas"), "removed_lines", F.array_join("warnings", ",").alias("warnings"))


def block_chunks(spark, sf_dir):
    rows = chunking.block_chunks(blocks_of(spark, sf_dir), 400, 50)
    return rows.select("document_id", "chunk_index", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"), "start_char", "end_char", F.array_join("block_types", ",").alias("block_types"), "exceeds")


def chunk_list(spark, sf_dir):
    rows = chunks_of(spark, sf_dir).select("chunk_id", "document_id", F.length("text").alias("n_chars"))
    return rows.orderBy("chunk_id").limit(20)


def chunk_lookup(spark, sf_dir):
    """Each document's first chunk, looked up by its id."""
    chunks = chunks_of(spark, sf_dir)
    wanted = documents(spark, sf_dir).select(F.concat("source_path", F.lit("::chunk-0000")).alias("chunk_id"))
    return chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", "document_id", "start_char", "end_char", "text")


def chunk_preview(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", T.preview(F.col("text")).alias("preview"))


def tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", T.tokens(F.col("text")).alias("t")).select("document_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def token_ngrams(spark, sf_dir):
    rows = documents(spark, sf_dir).select("document_id", T.ngrams(T.tokens(F.col("text")), 3).alias("g"))
    return rows.select("document_id", F.size("g").alias("n_distinct"))


def text_hash(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", represent.text_hash(F.col("text")).alias("text_hash"))


def index_fingerprint(spark, sf_dir):
    return represent.index_fingerprint(text_hash(spark, sf_dir))


def listed_fingerprint(spark, sf_dir):
    return represent.listed_fingerprint(text_hash(spark, sf_dir))


def file_hashes(spark, sf_dir):
    """Hashes of documents as files, whatever their line ends."""
    return table(spark, sf_dir, "documents").select("doc_id", represent.canonical_hash(F.col("text")).alias("file_sha256"))


def header_footer_filter(spark, sf_dir):
    return parse.repeated_edge_lines(pages_of(spark, sf_dir))


def formula_lines(spark, sf_dir):
    rows = lines_of(spark, sf_dir).where(T.formula_line(F.col("text")))
    return rows.groupBy("document_id").agg(F.count("*").alias("n_formula_lines"))


def table_serialize(spark, sf_dir):
    """Lines with pipes, as the rows of one table for each document."""
    rows = lines_of(spark, sf_dir).where(F.contains("text", F.lit(" | ")))
    cells = F.split("text", r" \| ")
    tables = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_index", cells.alias("cells")))).alias("rows"))
    shown = parse.serialize_table(F.transform("rows", lambda r: r["cells"]))
    return tables.select("document_id", F.size("rows").alias("n_rows"), shown.alias("table"))


def ingest_summary(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.length("text") == 0).alias("n_empty"))


def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.sha2(T.clean_pages(F.col("text")), 256).alias("clean_sha256"))


def redact_lines(spark, sf_dir):
    hidden = T.redact_lines(F.col("text"))
    rows = documents(spark, sf_dir).select("document_id", hidden.alias("h"))
    return rows.select("document_id", F.sha2("h", 256).alias("redacted_sha256"), (F.size(F.split("h", "<hidden>")) - 1).alias("n_hidden"))


def source_label(spark, sf_dir):
    """Labels of chunks with their pages; every fourth document's chunks are tables, every other document has no pages."""
    rows = chunks_of(spark, sf_dir)
    paged = F.col("document_id") % 2 == 0
    first = F.when(paged, (F.col("start_char") / 3000).cast("int") + 1)
    last = F.when(paged, ((F.col("end_char") - 1) / 3000).cast("int") + 1)
    table = F.when(F.col("document_id") % 4 == 0, F.col("chunk_index") % 3)
    return rows.select("chunk_id", T.source_label(F.col("source_path"), first, last, table).alias("label"))


def source_lines(spark, sf_dir):
    rows = represented(spark, sf_dir)
    warnings = F.when(F.col("document_id") % 5 == 0, F.array(F.lit("odd"), F.lit("old"))).otherwise(F.array().cast("array<string>"))
    lines = T.source_lines(F.col("media_type"), F.col("page_start"), F.col("page_end"), F.col("block_types"), F.col("possible_formula"), warnings)
    return rows.select("chunk_id", F.array_join(lines, "; ").alias("lines"))


def page_groups(spark, sf_dir):
    """Lines as blocks of pages of ten lines: runs of useful ones, tables alone; short lines are of no use."""
    rows = blocks_of(spark, sf_dir).withColumn("page", F.floor(F.col("block_index") / 10).cast("int"))
    kind = F.when(F.length("text") < 30, "heading").otherwise(F.col("block_type"))
    rows = rows.withColumns({"block_type": kind, "strategy": F.when(F.length("text") % 2 == 0, "even").otherwise("odd"), "warning": F.when(F.length("text") > 300, "long"), "removed_lines": F.length("text") % 3})
    return evidence.group_page_blocks(rows)


def _sectioned(spark, sf_dir) -> DataFrame:
    """Chunks with a section: the first line that starts in them, where it is short."""
    rows = chunks_of(spark, sf_dir)
    line = F.regexp_extract("text", r"\n([^\n]{1,40})\n", 1)
    return rows.withColumn("section", F.nullif(line, F.lit(""))).withColumn("block_type", F.lit("paragraph"))


def section_propagation(spark, sf_dir):
    return represent.propagate_sections(_sectioned(spark, sf_dir)).select("chunk_id", "section", "effective_section")


def represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what they may carry: sections, pages, types of blocks; every third document has a title, every other one is a PDF."""
    rows = _sectioned(spark, sf_dir)
    first, last = F.floor(F.col("start_char") / 3000), F.floor((F.col("end_char") - 1) / 3000)
    types = F.when(F.contains("text", F.lit(" | ")), F.array(F.lit("table"), F.lit("paragraph"))).otherwise(F.array(F.lit("paragraph")))
    return rows.withColumns({
        "page_start": (first + 1).cast("int"), "page_end": (last + 1).cast("int"), "block_types": types, "possible_formula": F.contains("text", F.lit("=")),
        "title": F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("Document "), F.col("document_id").cast("string"))), "section_title": F.col("section"),
        "media_type": F.when(F.col("document_id") % 2 == 0, "application/pdf").otherwise("text/plain"), "formula_lines": F.filter(F.split("text", "\n"), T.formula_line),
    })


def structured_text(spark, sf_dir):
    rows = represent.representations(represented(spark, sf_dir), "structured_document_text_v1")
    return rows.select("chunk_id", F.sha2("representation", 256).alias("representation_sha256"), F.length("representation").alias("n_chars"))


def cleaned_text(spark, sf_dir):
    """The text of PDFs' chunks with their own or the last heading, and their formulas; a chunk of page numbers alone has an empty one."""
    rows = represented(spark, sf_dir).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").drop("section_title")
    rows = represent.representations(rows, "cleaned_pdf_formula_text_v1", keep_empty=True)
    return rows.select("chunk_id", F.sha2("representation", 256).alias("representation_sha256"), F.length("representation").alias("n_chars"))


def query_text(spark, sf_dir):
    made = represent.query_representation(F.col("text"), "instructed_query_v1")
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(made, 256).alias("representation_sha256"))


def ingest_report(spark, sf_dir):
    """Documents by what they are read as: a third as Markdown, a third as text, the rest skipped."""
    kind = F.element_at(F.array(F.lit(".md"), F.lit(".TXT"), F.lit(".bin")), (F.col("document_id") % 3 + 1).cast("int"))
    rows = documents(spark, sf_dir).select(F.concat("source_path", kind).alias("path"), F.length("text").alias("n_chars"))
    return files.report(rows)


def markdown_blocks(spark, sf_dir):
    rows = parse.markdown_blocks(markdown_of(spark, sf_dir))
    return rows.select("document_id", "block_index", "block_type", "start_char", "end_char", "level", F.array_join("heading_path", " > ").alias("path"), F.sha2("text", 256).alias("text_sha256"))


def evidence_groups(spark, sf_dir):
    return evidence.group_blocks(parse.markdown_blocks(markdown_of(spark, sf_dir)))


def observational_slices(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    return documents(spark, sf_dir).join(labels, "document_id", "left").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        line_offsets, text_blocks, sliding_chunks, split_oversized, packed_in_parallel, block_metadata, block_chunks, chunk_list, chunk_lookup, chunk_preview, tokenize, token_ngrams, text_hash,
        index_fingerprint, listed_fingerprint, file_hashes, header_footer_filter, formula_lines, table_serialize, ingest_summary, ingest_report, clean_text, redact_lines,
        source_label, source_lines, page_groups, section_propagation, structured_text, cleaned_text, query_text, markdown_blocks, evidence_groups, observational_slices,
    )
}

W = r"[\p{L}\p{N}_]+"
SECTIONED = CHUNKS + r", sectioned as (select *, nullif(regexp_extract(text, '\n([^\n]{1,40})\n', 1), '') section from chunks)"
FORMULA = (
    r"(regexp_matches(line, '(?i)\b(rrf\s*\(|mrr\b|recall@|hit@)') or regexp_matches(line, '[=+\-*/^<>≈≤≥∑Σ∫√∂αβγλθ]') and regexp_matches(line, '\p{Nd}') and regexp_matches(line, '\p{L}'))"
)


def _markdown() -> str:
    """CTEs from web pages to the blocks of their Markdown ``mb``. The pages give no code blocks and no tables, so there are none here."""
    text = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', '', 'g')"
    for tag, mark in (("h1", "# "), ("h2", "## "), ("h3", "### "), ("li", "- ")):
        text = f"regexp_replace({text}, '(?is)<{tag}[^>]*>', chr(10) || chr(10) || '{mark}', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?is)</?(p|div|article|nav|ul|ol|br|h[1-6]|li)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"
    heading = parse.HEADING
    return f"""md as (select page_id document_id, {text} t from pages)
  , ml as (select document_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) i from md)
  , mk as (select *, coalesce(sum(length(line) + 1) over (partition by document_id order by i rows between unbounded preceding and 1 preceding), 0) s, case when regexp_matches(trim(line), '{heading}') then 'heading'
      when regexp_matches(line, '{parse.QUOTE}') then 'blockquote' when regexp_matches(line, '{parse.LIST}') then 'list' when trim(line) <> '' then 'paragraph' else 'blank' end kind from ml)
  , mi as (select *, sum(fresh::int) over (partition by document_id order by i) island from (select *, kind = 'heading' or kind is distinct from lag(kind) over (partition by document_id order by i) fresh from mk))
  , mg as (select document_id, min(i) i, any_value(kind) kind, string_agg(line, chr(10) order by i) x, min(s)::int s from mi where kind <> 'blank' group by document_id, island)
  , mh as (select document_id, i, length(regexp_extract(trim(x), '{heading}', 1)) lv, regexp_extract(trim(x), '{heading}', 2) title from mg where kind = 'heading')
  , mo as (select b.document_id, b.i bi, h.i hi, lv, title, min(lv) over (partition by b.document_id, b.i order by h.i rows between 1 following and unbounded following) later from mg b join mh h on h.document_id = b.document_id and h.i <= b.i)
  , mp as (select document_id, bi i, string_agg(title, ' > ' order by hi) path from mo where later is null or later > lv group by document_id, bi)
  , mb as (select document_id, (row_number() over (partition by document_id order by i) - 1)::int block_index, kind block_type, s start_char, (s + length(x))::int end_char,
      case when kind = 'heading' then length(regexp_extract(trim(x), '{heading}', 1)) end::int "level", coalesce(path, '') path, x from mg left join mp using (document_id, i))"""


MARKDOWN = _markdown()


def packed_lines(size: int, split: bool) -> str:
    """Recursive CTEs from lines to chunks of blocks ``ck``: document_id, c (number), t (text), s, e, tab, cnt."""
    alone = f"(b.tab or b.n > {size})"
    return f"""{LINES}, bl as (select document_id, line, start_char s, start_char + length(line) e, contains(line, ' | ') tab, length(line) n, row_number() over (partition by document_id order by line_index) k from lines where line <> '')
      , pk as (select document_id, k, 0 c, n m, {alone} alone from bl b where k = 1
        union all select document_id, k, case when fits then c else c + 1 end, case when fits then m + 2 + n else n end, not fits and a
        from (select b.*, c, m, {alone} a, not alone and not {alone} and m + 2 + b.n <= {size} fits from pk join bl b on b.document_id = pk.document_id and b.k = pk.k + 1))
      , ck as (select document_id, c, string_agg(line, chr(10) || chr(10) order by k) t, min(s) s, max(e) e, bool_or(tab) tab, count(*) cnt from pk join bl using (document_id, k) group by document_id, c)"""


SQL = {
    "line_offsets": f"with {LINES} select document_id, line_index, start_char, line as text from lines",
    "text_blocks": f"""with {LINES}, i as (select *, sum((not regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]'))::int) over (partition by document_id order by line_index) island from lines
      ), b as (select document_id, island, min(start_char) start_char, string_agg(line, chr(10) order by line_index) as text from i
      where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') group by document_id, island)
      select document_id, (row_number() over (partition by document_id order by start_char) - 1)::int block_index, start_char, (start_char + length(text))::int end_char, text from b""",
    "sliding_chunks": f"with {CHUNKS} select chunk_id, document_id, source_path, chunk_index, start_char::int start_char, end_char::int end_char, text from chunks",
    "split_oversized": f"""with {DOCS}, p as (select document_id, t, unnest(range(0, ceil((length(t) - 1000) / 900.0)::int + 1)) piece from docs where length(t) > 1000)
      select document_id, piece::int piece, (piece * 900)::int start_char, least(piece * 900 + 1000, length(t))::int end_char, substr(t, piece * 900 + 1, 1000) as text from p""",
    "block_metadata": f"""with recursive {packed_lines(1200, False)}, li as (select c, line_index i, b.line, b.document_id from pk join bl b using (document_id, k) join lines l on l.document_id = b.document_id and l.start_char = b.s)
      select document_id, c::int chunk_index, (min(i) // 10)::int page_start, (max(i) // 10)::int page_end, coalesce(min_by(substr(line, 1, 12), i) filter (where regexp_matches(line, '^[A-Z]')), null) heading,
        (case when count(distinct length(line) % 2) = 1 then min(length(line) % 2) end)::int "level", min_by('text/plain', i) filter (where i % 3 <> 1) media_type, least(10, count(*) filter (where {FORMULA}))::int n_formulas,
        sum(length(line) % 3)::int removed_lines, coalesce(string_agg('line ' || i, ',' order by i) filter (where i % 4 = 0), '') warnings from li group by document_id, c""",
    "block_chunks": f"""with recursive {packed_lines(400, True)}, pc as (select document_id, c, tab, s, e, t, unnest(case when not tab and length(t) > 400 then range(0, ceil((length(t) - 400) / 350.0)::int + 1) else [null] end) j from ck)
      , pt as (select document_id, c, j, tab, case when j is null then t else substr(t, j * 350 + 1, 400) end x, case when j is null then s else s + j * 350 end a, e from pc)
      select document_id, (row_number() over (partition by document_id order by c, j) - 1)::int chunk_index, sha256(x) text_hash, length(x)::int n_chars, a::int start_char,
        (case when j is null then e else a + length(x) end)::int end_char, case when tab then 'table' else 'paragraph' end block_types, length(x) > 400 exceeds from pt""",
    "chunk_list": f"with {CHUNKS} select chunk_id, document_id, length(text)::int n_chars from chunks order by chunk_id limit 20",
    "chunk_lookup": f"with {CHUNKS} select chunk_id, document_id, start_char::int start_char, end_char::int end_char, text from chunks where chunk_index = 0",
    "chunk_preview": f"""with {CHUNKS}, f as (select chunk_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) x from chunks)
      select chunk_id, case when length(x) <= 80 then x else rtrim(substr(x, 1, 77)) || '...' end preview from f""",
    "tokenize": f"with {DOCS}, w as (select document_id, regexp_extract_all(lower(t), '{W}') w from docs) select document_id, len(w)::int n_tokens, sha256(array_to_string(w, ' ')) tokens_sha256 from w",
    "token_ngrams": f"""with {DOCS}, w as (select document_id, regexp_extract_all(lower(t), '{W}') w from docs)
      select document_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))::int n_distinct from w""",
    "text_hash": f"with {CHUNKS} select chunk_id, sha256(text) text_hash from chunks",
    "index_fingerprint": f"""with {CHUNKS}, h as (select sha256(chunk_id || ':' || sha256(text)) h from chunks)
      select sha256(count(*) || ':' || """ + " || ':' || ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::bigint::hugeint)" for i in range(4)) + """) fingerprint, count(*) n_chunks from h""",
    "listed_fingerprint": f"""with {CHUNKS} select sha256('[' || string_agg('{{"chunk_id":"' || chunk_id || '","text_sha256":"' || sha256(text) || '"}}', ',' order by chunk_id) || ']') fingerprint from chunks""",
    "file_hashes": "select doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) file_sha256 from documents",
    "ingest_report": """with d as (select ['.md', '.TXT', '.bin'][doc_id % 3 + 1] x, length(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) n from documents)
      select case x when '.md' then 'text/markdown' when '.TXT' then 'text/plain' end media_type, x <> '.bin' supported, count(*) n_files, sum(n)::bigint n_chars from d group by x""",
    "query_text": "select item_id, sha256('Instruct: Retrieve the document passage that best answers the query. Distinguish the correct section from other passages in the same source document.' || chr(10) || 'Query: ' || text) representation_sha256 from benchmark",
    "header_footer_filter": f"""with {LINES}, p as (select document_id, (line_index // 10)::int page, line_index, line, lower(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) norm from lines
      ), e as (select *, case when row_number() over (partition by document_id, page order by line_index) <= 2 then 'header'
        when row_number() over (partition by document_id, page order by line_index desc) <= 2 then 'footer' end place from p
      ), v as (select document_id, norm, case when 2 * count(*) filter (where place = 'header') > count(*) then 'header' when 2 * count(*) filter (where place = 'header') < count(*) then 'footer'
          else min_by(place, (page, line_index)) end side from e
        where place is not null and length(norm) between 1 and 80 and len(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+(?:@[\\p{{L}}\\p{{N}}_]+)?')) between 1 and 8
          and document_id in (select document_id from p group by document_id having min(page) < max(page)) group by document_id, norm having count(*) >= 2)
      select document_id, page, line_index, line as text, coalesce(side = place, false) removed from e left join v using (document_id, norm)""",
    "formula_lines": f"with {LINES} select document_id, count(*) n_formula_lines from lines where {FORMULA} group by document_id",
    "ingest_summary": f"with {DOCS} select source, lang, count(*) n_documents, sum(length(t))::bigint n_chars, count(*) filter (where t = '') n_empty from docs group by source, lang",
    "table_serialize": f"""with {LINES}, r as (select document_id, line_index, list_transform(string_split(line, ' | '),
        lambda x: replace(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '|', '\\|')) c from lines where contains(line, ' | ')
      ), k as (select *, row_number() over (partition by document_id order by line_index) n, max(len(c)) over (partition by document_id) w from r where len(list_filter(c, lambda x: x <> '')) > 0
      ), s as (select document_id, n, w, list_concat(c, list_transform(range(w - len(c)), lambda i: '')) c from k
      ), o as (select document_id, string_agg('| ' || array_to_string(case when n = 1 then list_transform(c, lambda x, i: case when x = '' then 'Column ' || i else x end) else c end, ' | ') || ' |'
        || case when n = 1 then chr(10) || '|' || repeat('---|', w) else '' end, chr(10) order by n) t from s group by document_id)
      select document_id, count(*)::int n_rows, coalesce(any_value(t), '') "table" from r left join o using (document_id) group by document_id""",
    "clean_text": f"""with {DOCS} select document_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)),
      lambda x: not regexp_matches(trim(x), '^(page )?[0-9]{{1,4}}$')), chr(10)), '\\(cid:[0-9]+\\)', ' ', 'g'), '([\\p{{L}}])-\\n([\\p{{Ll}}])', '\\1\\2', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) clean_sha256 from docs""",
    "redact_lines": f"""with {DOCS}, h as (select document_id, array_to_string(list_transform(string_split(t, chr(10)),
      lambda x: case when regexp_matches(x, '(?i)(api_key|apikey|secret|token|password|authorization)') then '<hidden>' else x end), chr(10)) h from docs)
      select document_id, sha256(h) redacted_sha256, (len(string_split(h, '<hidden>')) - 1)::int n_hidden from h""",
    "source_label": f"""with {CHUNKS}, p as (select chunk_id, document_id, chunk_index, (start_char // 3000) + 1 a, ((end_char - 1) // 3000) + 1 b from chunks)
      select chunk_id, document_id || case when document_id % 2 = 1 then '' when a = b then ' p.' || a else ' pp.' || a || '-' || b end || case when document_id % 4 = 0 then ' table ' || chunk_index % 3 else '' end "label" from p""",
    "source_lines": f"""with {CHUNKS}, p as (select *, (start_char // 3000) + 1 a, ((end_char - 1) // 3000) + 1 b, document_id % 2 = 0 pdf from chunks)
      select chunk_id, case when pdf then 'type: pdf; page range: ' || case when a = b then a::varchar else a || '-' || b end else 'type: text' end || '; block type: ' || case when contains(text, ' | ') then 'table, paragraph' else 'paragraph' end
        || case when pdf and contains(text, '=') then '; possible formula: yes' else '' end || case when pdf and document_id % 5 = 0 then '; warnings: odd, old' else '' end "lines" from p""",
    "page_groups": f"""with {LINES}, b as (select document_id, line_index, line_index // 10 page, line, case when length(line) < 30 then 'heading' when contains(line, ' | ') then 'table' else 'paragraph' end t from lines)
      , f as (select *, t <> 'heading' u, coalesce(lag(t) over w, 'heading') lt, lag(page) over w lp from b window w as (partition by document_id order by line_index))
      , r as (select *, (sum((u and (lt = 'heading' or t = 'table' or lt = 'table' or page is distinct from lp))::int) over (partition by document_id order by line_index))::int run from f)
      select document_id, run, min(page)::int page, min(line_index) first_block, count(*) n_blocks, sum(length(line))::bigint n_chars, case when count(distinct length(line) % 2) > 1 then 'mixed' when max(length(line) % 2) = 0 then 'even' else 'odd' end strategy,
        case when max(length(line)) > 300 then 'long' end warnings, sum(length(line) % 3)::bigint removed_lines from r where u group by document_id, run""",
    "section_propagation": f"""with {SECTIONED} select chunk_id, section, last_value(section ignore nulls) over (partition by document_id order by chunk_index
      rows between unbounded preceding and current row) effective_section from sectioned""",
    "structured_text": f"""with {SECTIONED}, r as (select chunk_id, 'Document title: ' || case when document_id % 3 = 0 then 'Document ' || document_id else document_id::varchar end || chr(10) || 'Source: ' || source_path || chr(10)
      || 'Section: ' || coalesce(nullif(trim(regexp_replace(section, '[\\s]+', ' ', 'g')), ''), 'unknown') || chr(10) || 'Page: ' || case when start_char // 3000 = (end_char - 1) // 3000 then (start_char // 3000 + 1)::varchar
        else (start_char // 3000 + 1) || '-' || ((end_char - 1) // 3000 + 1) end || chr(10) || 'Block types: ' || case when contains(text, ' | ') then 'paragraph, table' else 'paragraph' end || chr(10)
      || 'Signals: ' || case when contains(text, '=') and contains(text, ' | ') then 'formula, table' when contains(text, '=') then 'formula' when contains(text, ' | ') then 'table' else 'none' end
      || chr(10) || 'Content:' || chr(10) || text r from sectioned) select chunk_id, sha256(r) representation_sha256, length(r)::int n_chars from r""",
    "observational_slices": "select lang, quality, toxic, count(*) n from documents left join labels using (doc_id) group by all",
    "markdown_blocks": f'with {MARKDOWN} select document_id, block_index, block_type, start_char, end_char, "level", path, sha256(x) text_sha256 from mb',
    "evidence_groups": f"""with {MARKDOWN}, u as (select *, block_type <> 'heading' useful, lag(block_type <> 'heading') over w before, lag(path) over w path_before from mb window w as (partition by document_id order by block_index))
      , r as (select *, (sum((useful and (not coalesce(before, false) or path <> path_before))::int) over (partition by document_id order by block_index))::int run from u)
      select document_id, run, path, min(block_index) first_block, count(*) n_blocks, sum(length(x))::bigint n_chars from r where useful group by document_id, run, path""",
}
SQL["packed_in_parallel"] = SQL["block_chunks"]

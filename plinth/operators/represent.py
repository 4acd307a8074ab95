"""Text that stands for a chunk in an index, and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import SPACES, let
from plinth.functions.unicode import formula_evidence

# Kinds of text for chunks and queries, what stands before an instructed query, what headings begin with and can't hold.
REPRESENTATIONS = ("raw_chunk_text_v1", "structured_document_text_v1", "cleaned_pdf_section_text_v1", "cleaned_pdf_formula_text_v1")
QUERY_REPRESENTATIONS = ("raw_query_v1", "instructed_query_v1")
INSTRUCTION = "Instruct: Retrieve the document passage that best answers the query. Distinguish the correct section from other passages in the same source document.\nQuery: "
STRUCTURAL, LOCAL = r"(?i)^(chapter|part|section)\b.{2,160}$", r"(?i)^(definition|example|theorem|lemma|proposition|corollary|exercise)\b.{2,160}$"
NUMBERED, LED, NUMBER, CID = r"^([0-9]+(?:\.[0-9]+){1,4}) +(.{3,160})$", r"^[0-9]{1,4} +(.{3,120})$", r"^[0-9]{1,4}$", r"(?i)\(cid:[0-9]+\)"
MATH_NOISE = r"[=<>≤≥≈∑∫√^{}\[\]]"
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "over", "the", "to", "with")
LIBRARY_WORDS = (
    "cambridge", "copyright", "discrete", "geometry", "institute", "isbn", "library", "longman", "monographs", "north-holland", "press", "series", "university", "volume", "vol", "wiley",
    "springer", "surveys",
)
#: Characters of a piece of a listed fingerprint.
PIECE = 1 << 14
#: Columns of chunks that are used where they are there.
OPTIONAL = {
    "document_title": "string", "title": "string", "heading_path": "array<string>", "section_title": "string", "page_start": "int", "page_end": "int", "block_types": "array<string>",
    "media_type": "string", "possible_formula": "boolean", "formula_lines": "array<string>", "edge_lines": "array<string>",
}


def _flat(text: Column) -> Column:
    """On one line, single blanks between words."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def _said(text: Column) -> Column:
    """The text without white space around it; null where nothing is left."""
    return F.nullif(_flat(text), F.lit(""))


def _listed(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def _lines(text: Column, edges: Column) -> Column:
    """Lines of a page on which something stands, without those that repeat on other pages (``edges``)."""
    hidden = F.transform(_listed(edges), lambda x: F.lower(_flat(x)))
    flat = F.transform(F.split(text, "\r\n?|\n"), lambda x: _flat(F.regexp_replace(x, CID, "")))
    return F.filter(flat, lambda x: (x != "") & ~F.array_contains(hidden, F.lower(x)))


def looks_like_title(line: Column) -> Column:
    """Three to fourteen words, most of them capitalised, no sentence, no formula, no imprint."""

    def judged(words: Column) -> Column:
        telling = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
        capital = F.size(F.filter(telling, lambda w: w.rlike("^[A-Z]")))
        imprint = F.exists(telling, lambda w: F.lower(w).isin(*LIBRARY_WORDS))
        return F.size(words).between(3, 14) & (F.size(telling) >= 2) & ~imprint & (capital >= 0.6 * F.size(telling))

    plain = (F.length(line) <= 120) & ~line.rlike(r"[.?!:;]$") & ~F.contains(line, F.lit(",")) & ~line.rlike(MATH_NOISE)
    return plain & let(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)), judged)


def heading_of(line: Column, after: Column, lead: Column) -> Column:
    """The heading that a line gives, and whether it holds for what follows, as a struct (heading, holds); null for none.

    after: the next line; lead: whether the line is one of the first three of its page.
    """

    def found(heading: Column, holds: bool) -> Column:
        return F.struct(heading.alias("heading"), F.lit(holds).alias("holds"))

    value, label, named = F.regexp_extract(line, LED, 1), F.regexp_extract(line, NUMBERED, 1), F.trim(F.regexp_extract(line, NUMBERED, 2))
    both = F.concat_ws(" ", label, named)
    several = (F.size(F.regexp_extract_all(named, F.lit("[A-Za-z]+"), F.lit(0))) >= 2) & ~named.rlike("[.?!]$")
    none = F.lit(None).cast("struct<heading:string,holds:boolean>")
    return (
        F.when(line.rlike(NUMBER), F.when(lead & looks_like_title(F.coalesce(after, F.lit(""))), found(after, True)))
        .when(line.rlike(STRUCTURAL), found(line, True))
        .when(line.rlike(LOCAL), found(line, False))
        .when(lead & (value != "") & (value.rlike(STRUCTURAL) | looks_like_title(value)), found(F.trim(value), True))
        .when(label == "", F.when(lead & looks_like_title(line), found(line, True)))
        .when(named.rlike(MATH_NOISE), none)
        .when(named.rlike(LOCAL), found(both, False))
        .when(looks_like_title(named), found(both, True))
        .when(several, found(both, False))
    )


def heading_scan(text: Column, edges: Column, first: int = 40, most: int = 3) -> Column:
    """A struct: ``local``, the first different headings among a page's first lines, and ``holds``, the last of those met that holds for what follows."""
    none = F.struct(F.array().cast("array<string>").alias("local"), F.lit(None).cast("string").alias("holds"))

    def scan(lines: Column) -> Column:
        def step(seen: Column, i: Column) -> Column:
            def taken(h: Column) -> Column:
                fresh = ~F.exists(seen["local"], lambda x: F.lower(x) == F.lower(h["heading"]))
                local = F.when(fresh, F.concat(seen["local"], F.array(h["heading"]))).otherwise(seen["local"])
                holds = F.when(h["holds"], h["heading"]).otherwise(seen["holds"])
                open_ = h.isNotNull() & (F.size(seen["local"]) < most)
                return F.when(open_, F.struct(local.alias("local"), holds.alias("holds"))).otherwise(seen)

            return let(heading_of(F.element_at(lines, i), F.get(lines, i), i <= 3), taken)

        return F.when(F.size(lines) > 0, F.aggregate(F.sequence(F.lit(1), F.least(F.size(lines), F.lit(first))), none, step)).otherwise(none)

    return let(_lines(text, edges), scan)


def clean_page(text: Column, edges: Column) -> Column:
    """A page's text without lines that repeat on other pages, lone page numbers, character codes, soft hyphens and hyphens at line ends, on one line."""
    hidden = F.transform(_listed(edges), lambda x: F.lower(_flat(x)))
    flat = F.transform(F.split(F.replace(text, F.lit("­"), F.lit("")), "\r\n?|\n"), _flat)
    kept = F.filter(flat, lambda x: ~F.array_contains(hidden, F.lower(x)) & ~x.rlike(NUMBER))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), CID, ""), r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    return _flat(joined)


def _source(chunks: DataFrame) -> Column:
    """The path as it may be shown: of an absolute one only the name."""
    raw = F.replace(F.coalesce(_said(F.col("source_path")), _said(F.col("document_id").cast("string"))), F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(raw, r"([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.when(raw.rlike("^(/|[A-Za-z]:/)"), name).otherwise(F.regexp_replace(raw, r"^[./]+", "")), F.lit("")), F.lit("unknown"))


def _page(chunks: DataFrame) -> Column:
    a, b = F.col("page_start"), F.col("page_end")
    return F.when(a.isNull(), "unknown").when(b.isNull() | (a == b), a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))


def representations(chunks: DataFrame, kind: str = REPRESENTATIONS[0], keep_empty: bool = False) -> DataFrame:
    """chunk_id and ``representation``, the text of a kind, for chunks (chunk_id, document_id, chunk_index, source_path, text, and any of OPTIONAL).

    The structured kind names title, source, section, page, block types and signals before the text. The cleaned kinds do the same for
    chunks of PDFs, whose section is that of their metadata, or else their own headings, or else the last that holds from a chunk of the
    document before; their text is cleaned, and one of which nothing is left is an error, or with ``keep_empty`` stays empty. The formula
    kind adds up to three formulas. Other chunks are structured.
    """
    if kind not in REPRESENTATIONS:
        raise ValueError(f"representation must be one of {', '.join(REPRESENTATIONS)}")
    if kind == REPRESENTATIONS[0]:
        return chunks.select("chunk_id", F.col("text").alias("representation"))
    rows = chunks.select("chunk_id", "document_id", "chunk_index", "source_path", "text", *(F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()))
    path, types = _listed(F.col("heading_path")), F.array_sort(F.array_distinct(_listed(F.col("block_types"))))
    source = _source(rows)
    stem = F.regexp_extract(source, r"([^/]+?)(\.[^./]*)?$", 1)
    title = F.coalesce(_said(F.col("document_title")), _said(F.col("title")), F.get(path, F.lit(0)), F.nullif(stem, F.lit("")), F.lit("unknown"))
    signals = F.concat(
        F.when(F.coalesce("possible_formula", F.lit(False)) | F.exists(types, lambda t: F.contains(F.lower(t), F.lit("formula"))), F.array(F.lit("formula"))).otherwise(F.array().cast("array<string>")),
        F.when(F.exists(types, lambda t: F.contains(F.lower(t), F.lit("table"))), F.array(F.lit("table"))).otherwise(F.array().cast("array<string>")),
    )
    own_section = F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), _said(F.col("section_title")))
    pdf = F.coalesce((_said(F.col("media_type")) == "application/pdf") | F.lower("source_path").rlike(r"\.pdf\s*$"), F.lit(False))

    def shown(section: Column, *more: Column, text: Column) -> Column:
        head = (("Document title", title), ("Source", source), ("Section", section), ("Page", _page(rows)), ("Block types", F.array_join(types, ", ")), ("Signals", F.array_join(signals, ", ")))
        blank = {"Block types": "unknown", "Signals": "none"}
        lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.nullif(v, F.lit("")), F.lit(blank.get(n, "unknown")))) for n, v in head]
        return F.concat_ws("\n", *lines, *more, F.lit("Content:"), text)

    plain = shown(own_section, text=F.col("text"))
    if kind == REPRESENTATIONS[1]:
        return rows.select("chunk_id", plain.alias("representation"))
    rows = rows.withColumns({"pdf": pdf, "own": own_section})
    rows = rows.withColumn("scan", F.when(F.col("pdf"), heading_scan(F.col("text"), F.col("edge_lines"))))
    before = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("pdf"), F.coalesce("scan.holds", "own")), ignorenulls=True).over(before)
    section = F.coalesce("own", F.nullif(F.array_join("scan.local", " | "), F.lit("")), last)
    clean = clean_page(F.col("text"), F.col("edge_lines"))
    rows = rows.withColumns({"section": section, "clean": clean})
    held = F.col("clean")
    if not keep_empty:
        held = F.when(held == "", F.raise_error(F.concat(F.lit("nothing is left of chunk "), "chunk_id"))).otherwise(held)
    more = []
    if kind == REPRESENTATIONS[3]:
        more.append(F.concat(F.lit("Formula evidence: "), F.coalesce(F.nullif(F.array_join(formula_evidence("formula_lines"), " | "), F.lit("")), F.lit("none"))))
    return rows.select("chunk_id", F.when(F.col("pdf"), shown(F.col("section"), *more, text=held)).otherwise(plain).alias("representation"))


def query_representation(query: Column, kind: str = QUERY_REPRESENTATIONS[0]) -> Column:
    if kind not in QUERY_REPRESENTATIONS:
        raise ValueError(f"representation must be one of {', '.join(QUERY_REPRESENTATIONS)}")
    return query if kind == QUERY_REPRESENTATIONS[0] else F.concat(F.lit(INSTRUCTION), query)


def propagate_sections(chunks: DataFrame) -> DataFrame:
    """Adds ``effective_section`` to (document_id, chunk_index, section, ...): a chunk's own section, or the last one before it."""
    order = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("effective_section", F.last("section", ignorenulls=True).over(order))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_hash(content: Column) -> Column:
    """The SHA-256 of a text file's bytes with line feeds as its only line ends."""
    return F.sha2(F.regexp_replace(content, "\r\n", "\n"), 256)


def index_fingerprint(hashes: DataFrame) -> DataFrame:
    """One row: n_chunks and a digest of all (chunk_id, text_hash), whatever their order.

    Every row's SHA-256 gives four numbers of 60 bits, which are summed; the digest is that of the sums. So it takes one aggregation, at
    any size. It isn't the digest of the sorted list, which has to be read in order (``listed_fingerprint``).
    """
    h = F.sha2(F.concat_ws(":", "chunk_id", "text_hash"), 256)
    words = [F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashes.select(h.alias("h")).agg(F.count("*").alias("n_chunks"), *(F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i, w in enumerate(words)))
    return sums.select(F.sha2(F.concat_ws(":", F.col("n_chunks").cast("string"), *(f"s{i}" for i in range(4))), 256).alias("fingerprint"), "n_chunks")


def listed_fingerprint(hashes: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row: the SHA-256 of the sorted (chunk_id, text_hash) as a JSON list, of any length.

    Rows are dealt into ranges, which are sorted and written out as JSON by many tasks, in pieces of some ``piece`` characters. The digest of
    a list goes on from what stands before, so one task reads the pieces in order, one at a time, and holds none of them.
    """
    spark = hashes.sparkSession
    row = F.to_json(F.struct("chunk_id", F.col("text_hash").alias("text_sha256")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashes.select("chunk_id", "text_hash", row.alias("row")).repartitionByRange(parts, "chunk_id", "text_hash").sortWithinPartitions("chunk_id", "text_hash")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([",".join(held)])], ["part", "n", "piece"])

        for batch in batches:
            for text in batch.column("row").to_pylist():
                held.append(text)
                size += len(text)
                if size >= piece:
                    yield out()
                    n, held, size = n + 1, [], 0
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for text in batch.column("piece"):
                whole.update((("," if n > 1 else "") + text.as_py()).encode())
                n += 1
        if n:
            whole.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()])], ["fingerprint"])

    pieces = dealt.select("row").mapInArrow(cut, "part int, n long, piece string")
    opened = spark.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("[").alias("piece"))
    return opened.unionByName(pieces).repartition(1).sortWithinPartitions("part", "n").mapInArrow(digest, "fingerprint string")

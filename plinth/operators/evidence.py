"""Evidence spans: building them, and mapping them onto chunks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.batches import slices
from plinth.functions.text import let, tokens
from plinth.operators.chunking import block_chunks


def group_blocks(blocks: DataFrame, useful: tuple[str, ...] = ("paragraph", "list", "table", "code", "blockquote")) -> DataFrame:
    """Runs of useful blocks (document_id, block_index, block_type, text, heading_path) under one heading."""
    order = Window.partitionBy("document_id").orderBy("block_index")
    rows = blocks.withColumn("useful", F.col("block_type").isin(*useful)).withColumn("path", F.array_join("heading_path", " > "))
    fresh = ~F.coalesce(F.lag("useful").over(order), F.lit(False)) | (F.lag("path").over(order) != F.col("path"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("useful") & fresh, 1).otherwise(0)).over(order)).where("useful")
    grouped = rows.groupBy("document_id", "run", "path").agg(F.min("block_index").alias("first_block"), F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return grouped.select("document_id", F.col("run").cast("int").alias("run"), "path", "first_block", "n_blocks", "n_chars")


def group_page_blocks(blocks: DataFrame, useful: tuple[str, ...] = ("paragraph", "list", "table", "code", "blockquote")) -> DataFrame:
    """Runs of useful blocks (document_id, block_index, block_type, text, page) of one page; a table is a run of its own.

    What the blocks say together: first block, their number, characters, page, and where blocks have them the strategy (mixed, where they
    differ), different warnings joined by semicolons, and removed lines in all.
    """
    order = Window.partitionBy("document_id").orderBy("block_index")
    rows = blocks.withColumn("useful", F.col("block_type").isin(*useful))
    table = F.col("block_type") == "table"
    rows = rows.withColumns({"before": F.lag("useful").over(order), "table_before": F.lag(table).over(order), "page_before": F.lag("page").over(order)})
    fresh = ~F.coalesce("before", F.lit(False)) | table | F.coalesce("table_before", F.lit(False)) | ~F.col("page").eqNullSafe(F.col("page_before"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("useful") & fresh, 1).otherwise(0)).over(order)).where("useful")
    more = []
    if "strategy" in blocks.columns:
        different = F.count_distinct("strategy")
        more.append(F.when(different > 1, "mixed").otherwise(F.max("strategy")).alias("strategy"))
    if "warning" in blocks.columns:
        seen = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "warning"))), lambda x: x["warning"]), lambda w: w.isNotNull())
        more.append(F.nullif(F.array_join(F.array_distinct(seen), "; "), F.lit("")).alias("warnings"))
    if "removed_lines" in blocks.columns:
        more.append(F.coalesce(F.sum("removed_lines"), F.lit(0)).cast("long").alias("removed_lines"))
    grouped = rows.groupBy("document_id", "run").agg(F.first("page").alias("page"), F.min("block_index").alias("first_block"), F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), *more)
    return grouped.withColumn("run", F.col("run").cast("int"))


def plain_path(path: Column) -> Column:
    """A path with forward slashes, none at its end."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")


def matching_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_path, right_path, kind) for paths (path) that are equal (exact) or of which one ends in the other after a slash (suffix).

    Either side's tails meet the other side's whole paths, so paths that only share a file's name don't meet.
    """

    def tails(path: str) -> Column:
        parts = F.split(path, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))

    a = left.select(plain_path(F.col("path")).alias("left_path")).distinct()
    b = right.select(plain_path(F.col("path")).alias("right_path")).distinct()
    down = a.select("left_path", tails("left_path").alias("right_path")).join(b, "right_path").select("left_path", "right_path")
    up = b.select("right_path", tails("right_path").alias("left_path")).join(a, "left_path").select("left_path", "right_path")
    return down.union(up).distinct().withColumn("kind", F.when(F.col("left_path") == F.col("right_path"), "exact").otherwise("suffix"))


#: Characters of one bin, in which ranges of spans and chunks meet.
BIN = 4096


def map_spans(spans: DataFrame, chunks: DataFrame, least: float = 0.3, source_only: bool = False) -> DataFrame:
    """Chunks that hold evidence: (span_id, chunk_id, overlap_ratio, method, kind).

    Paths must match (``matching_paths``). Then, of spans (span_id, source_path, start_char, end_char) and chunks (chunk_id, source_path,
    start_char, end_char), those count that cover at least ``least`` of the span (char_overlap); for a span without such a chunk, those
    that share a page (page_overlap), where both have page_start and page_end; for a span with neither range nor pages, all chunks of
    its source, if ``source_only`` allows it. Ranges meet in bins of their path, pages on their numbers.
    """
    pages = {"page_start", "page_end"} <= {*spans.columns} & {*chunks.columns}
    kept = ["start_char", "end_char"] + (["page_start", "page_end"] if pages else [])
    left = spans.select("span_id", plain_path(F.col("source_path")).alias("left_path"), *(F.col(c).alias(f"span_{c}") for c in kept))
    right = chunks.select("chunk_id", plain_path(F.col("source_path")).alias("right_path"), *kept)
    paths = matching_paths(left.select(F.col("left_path").alias("path")), right.select(F.col("right_path").alias("path")))
    left = left.join(paths, "left_path")

    def bins(first: str, last: str) -> Column:
        return F.sequence(F.floor(F.col(first) / BIN), F.floor((F.col(last) - 1) / BIN))

    ranged = left.where("span_start_char >= 0 and span_end_char > span_start_char").withColumn("bin", F.explode(bins("span_start_char", "span_end_char")))
    holding = right.where("start_char >= 0 and end_char > start_char").withColumn("bin", F.explode(bins("start_char", "end_char")))
    shared = F.least("span_end_char", "end_char") - F.greatest("span_start_char", "start_char")
    met = ranged.join(holding, ["right_path", "bin"]).where(F.col("bin") == F.floor(F.greatest("span_start_char", "start_char") / BIN))
    met = met.withColumn("overlap_ratio", shared / (F.col("span_end_char") - F.col("span_start_char"))).where(F.col("overlap_ratio") >= least)
    out = met.select("span_id", "chunk_id", "overlap_ratio", F.lit("char_overlap").alias("method"), "kind")
    if pages:
        rest = left.join(out.select("span_id").distinct(), "span_id", "left_anti")
        first, last = F.coalesce("span_page_start", "span_page_end"), F.coalesce("span_page_end", "span_page_start")
        paged = rest.withColumns({"a": first, "b": last}).where("a >= 1 and b >= a").withColumn("page", F.explode(F.sequence("a", "b")))
        own = right.withColumns({"a": F.coalesce("page_start", "page_end"), "b": F.coalesce("page_end", "page_start")}).where("a >= 1 and b >= a")
        own = own.select("chunk_id", "right_path", F.explode(F.sequence("a", "b")).alias("page"))
        by_page = paged.join(own, ["right_path", "page"]).select("span_id", "chunk_id", F.lit(None).cast("double").alias("overlap_ratio"), F.lit("page_overlap").alias("method"), "kind").distinct()
        out = out.union(by_page)
    if source_only:
        bare = "coalesce(span_start_char < 0 or span_end_char <= span_start_char, true)"
        if pages:
            bare += " and not coalesce(coalesce(span_page_start, span_page_end) >= 1 and coalesce(span_page_end, span_page_start) >= coalesce(span_page_start, span_page_end), false)"
        alone = left.where(bare).join(right.select("chunk_id", "right_path"), "right_path")
        out = out.union(alone.select("span_id", "chunk_id", F.lit(None).cast("double").alias("overlap_ratio"), F.lit("source_only").alias("method"), "kind"))
    return out


def unmatched_spans(spans: DataFrame, mapped: DataFrame) -> DataFrame:
    """The spans that no chunk holds."""
    return spans.join(mapped.select("span_id").distinct(), "span_id", "left_anti")


def coverage(spans: DataFrame, results: DataFrame) -> DataFrame:
    """(span_id, coverage): the share of a span that a union of result ranges (span_id, start_char, end_char) covers.

    Where spans and results have page_start and page_end, a span without a range gets the share of its pages that results hold, and one
    with neither a null.
    """
    pages = {"page_start", "page_end"} <= {*spans.columns} & {*results.columns}
    has = F.coalesce((F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")), F.lit(False))
    ranged = spans.where(has)
    cut = results.join(ranged.select("span_id", F.col("start_char").alias("s"), F.col("end_char").alias("e")), "span_id")
    cut = cut.select("span_id", F.greatest("start_char", "s").alias("a"), F.least("end_char", "e").alias("b")).where("a < b")
    reach = F.max("b").over(Window.partitionBy("span_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(reach, F.col("a"))))
    covered = cut.withColumn("fresh", fresh).groupBy("span_id").agg(F.sum("fresh").alias("covered"))
    share = F.coalesce("covered", F.lit(0)) / (F.col("end_char") - F.col("start_char"))
    out = ranged.join(covered, "span_id", "left").select("span_id", share.alias("coverage"))
    others = spans.where(~has)
    if not pages:
        return out.union(others.select("span_id", F.lit(None).cast("double")))
    first, last = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    all_ = F.when((first >= 1) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    wanted = others.select("span_id", all_.alias("pages"))
    held = results.where((first >= 1) & (last >= first)).select("span_id", F.explode(F.sequence(first, last)).alias("page")).distinct()
    held = held.join(wanted, "span_id").where(F.array_contains("pages", F.col("page"))).groupBy("span_id").agg(F.count("*").alias("n"))
    rows = wanted.join(held, "span_id", "left")
    return out.union(rows.select("span_id", F.when(F.size("pages") > 0, F.coalesce("n", F.lit(0)) / F.size("pages"))))


#: Bytes of text whose passages are gathered at once.
TEXT_SLICE = 2 << 20
#: Characters of all passages up to which they are sent to all tasks and sought together.
SENT_CHARACTERS = 4 << 20


def find_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Where passages (query_id, query) stand word for word in documents (document_id, text): query_id, document_id, place, start_char, end_char.

    Every place counts, also those that overlap; ``place`` numbers those of a passage in a document from 0; passages without characters
    are left out. Up to SENT_CHARACTERS, counted before, all passages are sought in one narrow pass over the texts; beyond, they meet
    the documents by a join.
    """
    wanted = passages.where(F.length("query") > 0).select("query_id", "query")
    if (wanted.agg(F.sum(F.length("query"))).first()[0] or 0) > SENT_CHARACTERS:
        return _find_by_join(docs, wanted)
    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = wanted.toArrow().combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought: dict[str, list[int]] = {}
        for i, q in enumerate(shared.value.column("query").to_pylist()):
            sought.setdefault(q, []).append(i)
        automaton = ahocorasick.Automaton()
        for q, at in sought.items():
            automaton.add_word(q, (len(q), at))
        if sought:
            automaton.make_automaton()
        for batch in (part for whole in batches for part in slices(whole, most=TEXT_SLICE)):
            found: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column("text").to_pylist() if sought else []):
                places: dict[int, int] = {}
                for last, (size, at) in automaton.iter(text):
                    for i in at:
                        n = places[i] = places.get(i, -1) + 1
                        found.append((i, row, n, last + 1 - size, last + 1))
            asked_at, row, *numbers = map(list, zip(*found, strict=True)) if found else ([], [], [], [], [])
            columns = [shared.value.column("query_id").combine_chunks().take(pa.array(asked_at, pa.int64())), batch.column("document_id").take(pa.array(row, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in numbers)], ["query_id", "document_id", "place", "start_char", "end_char"])

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((wanted, "query_id"), (rows, "document_id"))]
    return rows.mapInArrow(run, f"query_id {kinds[0]}, document_id {kinds[1]}, place int, start_char int, end_char int")


def _find_by_join(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """As find_passages. A passage's second to fourth tokens, without its last, are its key; documents meet it on the hash of their runs
    of as many tokens, and the text decides. Passages of one or two tokens, or none, are sought in every document."""
    n = F.greatest(F.lit(0), F.least(F.lit(3), F.size("w") - 2))
    keys = passages.where(F.length("query") > 0).withColumn("w", tokens(F.col("query"))).withColumn("n", n)
    keys = keys.select("query_id", "query", "n", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("key"))
    lengths = [r["n"] for r in keys.select("n").distinct().collect()]  # four at most

    def hashes(w, k):
        each = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>"))

    runs = docs.select("document_id", tokens(F.col("text")).alias("w"))
    runs = runs.select("document_id", F.explode(F.array_distinct(let(F.col("w"), lambda w: F.concat(F.array().cast("array<bigint>"), *(hashes(w, k) for k in lengths if k))))).alias("key"))
    met = runs.join(keys.where("n > 0"), "key").select("query_id", "query", "document_id")
    if 0 in lengths:
        met = met.union(docs.join(keys.where("n = 0"), F.contains("text", "query")).select("query_id", "query", "document_id"))
    found = met.join(docs.select("document_id", "text"), "document_id").where(F.contains("text", "query"))
    literal = F.concat(F.lit(r"(?=\Q"), F.replace("query", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split("text", literal), F.length)  # all but the first begin with the passage
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda seen, size: F.concat(seen, F.array(F.element_at(seen, -1) + size)))
    starts = let(ends, lambda e: F.slice(e, F.when(F.startswith("text", "query"), 1).otherwise(2), F.greatest(F.lit(0), F.size(e) - F.when(F.startswith("text", "query"), 1).otherwise(2))))
    found = found.select("query_id", "document_id", F.length("query").alias("size"), F.posexplode(starts).alias("place", "start_char"))
    return found.select("query_id", "document_id", "place", "start_char", (F.col("start_char") + F.col("size")).alias("end_char"))


def build_spans(blocks: DataFrame, least: int = 250, most: int = 1200) -> DataFrame:
    """Evidence spans from blocks (document_id, block_index, block_type, text, start_char, end_char): packed up to ``most`` characters,
    longer text cut at its last blank in the second half, shorter than ``least`` left out but for a table alone; numbered in each document."""
    packed = block_chunks(blocks, most, split=False)
    cut = F.substring("text", 1, most)
    blank = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    whole = F.length("text") <= most
    text = F.when(whole, F.col("text")).when(blank >= most // 2, F.substring(cut, F.lit(1), blank)).otherwise(cut)
    alone = F.col("single") & (F.col("block_types")[0] == "table")
    rows = packed.withColumn("span_text", F.when(alone, F.col("text")).otherwise(text)).where((F.length("span_text") >= least) | alone)
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    name = F.concat(F.col("document_id").cast("string"), F.lit("::span-"), F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0")))
    end = F.when(whole | alone, F.col("end_char")).otherwise(F.col("start_char") + F.length("span_text"))
    return rows.select(name.alias("span_id"), "document_id", "start_char", end.alias("end_char"), F.sha2("span_text", 256).alias("text_sha256"), F.length("span_text").alias("n_chars"))


def path_match(actual, expected):
    """exact, suffix (one ends with the other after a slash), or none."""
    tail = F.endswith(actual, F.concat(F.lit("/"), expected)) | F.endswith(expected, F.concat(F.lit("/"), actual))
    return F.when(actual == expected, "exact").when(tail, "suffix").otherwise("none")

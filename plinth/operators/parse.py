"""Documents to lines and typed blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.batches import slices
from plinth.functions.text import let

#: Bytes of text whose lines are looked at together.
TEXT_SLICE = 2 << 20

class _Lines(NamedTuple):
    """The lines of a batch of texts, one after another: their text's row, number, first character and length, and whether they are blank."""

    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    length: np.ndarray
    blank: np.ndarray
    text: pa.Array


#: What ends a line beside a line feed: the other line ends of Unicode text. Carriage returns are line feeds by then.
LINE_ENDS = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _lines_of(texts: pa.Array) -> _Lines:
    if pc.any(pc.match_substring_regex(texts, LINE_ENDS)).as_py():
        texts = pc.replace_substring_regex(texts, LINE_ENDS, "\n")
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    sizes = np.asarray(pc.list_value_length(lists))
    row = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    length = np.asarray(pc.utf8_length(flat), np.int64)
    ends = np.cumsum(length + 1)
    start = ends - length - 1
    return _Lines(row, np.arange(len(flat)) - first[row], start - start[first][row] if len(flat) else start, length, ~np.asarray(pc.match_substring_regex(flat, r"[^ \t\n\v\f\r]"), bool), flat)


def _by_batch(docs: DataFrame, columns: dict[str, str], made: Callable[[pa.Array], tuple]) -> DataFrame:
    """document_id and what ``made`` gives for the texts of a batch: the row numbers of its results, and their columns."""
    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most=TEXT_SLICE)):
            row, *found = made(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array(row)), *found], ["document_id", *columns])

    kind = rows.schema["document_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"document_id {kind}", *(f"{n} {k}" for n, k in columns.items())]))


def lines(docs: DataFrame) -> DataFrame:
    """document_id, line_index, start_char, and text of every line without its line feed. Nothing is shuffled."""

    def made(texts: pa.Array) -> tuple:
        x = _lines_of(texts)
        return x.row, pa.array(x.number, pa.int32()), pa.array(x.start, pa.int32()), x.text

    return _by_batch(docs, {"line_index": "int", "start_char": "int", "text": "string"}, made)


def line_texts(text: Column) -> Column:
    """The lines of a text as an array, divided as by ``lines``."""
    return F.split(text, LINE_ENDS.replace("[", "[\n"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Runs of lines that aren't blank: document_id, block_index, start_char, end_char, text. Nothing is shuffled."""

    def made(texts: pa.Array) -> tuple:
        x = _lines_of(texts)
        held = np.nonzero(~x.blank)[0]
        fresh = np.ones(len(held), bool)
        fresh[1:] = (np.diff(held) > 1) | (np.diff(x.row[held]) > 0)
        first, last = held[fresh], held[np.append(fresh[1:], True)] if len(held) else held
        row, start, end = x.row[first], x.start[first], x.start[last] + x.length[last]
        index = np.arange(len(row)) - np.searchsorted(row, row)
        whole = texts.to_pylist()
        text = [whole[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
        return row, pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())

    return _by_batch(docs, {"block_index": "int", "start_char": "int", "end_char": "int", "text": "string"}, made)


def repeated_edge_lines(pages: DataFrame, edge: int = 2, longest: int = 80, most_words: int = 8) -> DataFrame:
    """Lines (document_id, page, line_index, text) with ``removed``: short lines that repeat at the top or bottom of a document's pages.

    A line counts at the edge where it stands more often, or first; only copies at that edge are removed, and none where there is one page.
    """
    page = Window.partitionBy("document_id", "page")
    down, up = F.row_number().over(page.orderBy("line_index")), F.row_number().over(page.orderBy(F.desc("line_index")))
    rows = pages.withColumn("place", F.when(down <= edge, "header").when(up <= edge, "footer"))
    rows = rows.withColumn("norm", edge_text(F.col("text"))).withColumn("short", F.col("place").isNotNull() & short_edge(F.col("norm"), longest, most_words))
    joined = rows.join(edge_sides(rows.where("short"), pages), ["document_id", "norm"], "left")
    return joined.select("document_id", "page", "line_index", "text", F.coalesce(F.col("where") == F.col("place"), F.lit(False)).alias("removed"))


def edge_text(text: Column) -> Column:
    """What lines at the edges of pages are compared by."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def short_edge(norm: Column, longest: int = 80, most_words: int = 8) -> Column:
    """Whether a line is short enough for a header or footer, by its ``edge_text``."""
    words = F.size(F.regexp_extract_all(norm, F.lit(r"[\p{L}\p{N}_]+(?:@[\p{L}\p{N}_]+)?"), F.lit(0)))
    return F.length(norm).between(1, longest) & words.between(1, most_words)


def edge_sides(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, norm and ``where`` of what repeats in the short lines at edges (document_id, page, line_index, place, norm): the place
    from which its copies go. pages: (document_id, page); documents of one page have none."""
    first = F.min_by("place", F.struct("page", "line_index"))
    votes = rows.groupBy("document_id", "norm").agg(F.count_if(F.col("place") == "header").alias("h"), F.count("*").alias("n"), first.alias("first"))
    side = F.when(2 * F.col("h") > F.col("n"), "header").when(2 * F.col("h") < F.col("n"), "footer").otherwise(F.col("first"))
    several = pages.groupBy("document_id").agg((F.min("page") < F.max("page")).alias("several")).where("several").select("document_id")
    return votes.where("n >= 2").join(several, "document_id").select("document_id", "norm", side.alias("where"))


def malformed_table(rows: Column) -> Column:
    """Whether the rows of a table that have content differ in length."""
    kept = F.filter(F.transform(rows, lambda r: F.coalesce(r, F.array())), lambda r: F.exists(r, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    return F.size(F.array_distinct(F.transform(kept, F.size))) > 1


def serialize_table(rows: Column) -> Column:
    """A table (array of rows, arrays of cells) as a pipe table: rows without content dropped, white space collapsed, pipes escaped,
    short rows padded, blank headers numbered. Empty where nothing is left."""

    def cell(x: Column) -> Column:
        return F.replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))

    clean = F.filter(F.transform(rows, lambda r: F.transform(F.coalesce(r, F.array()), cell)), lambda r: F.exists(r, lambda x: x != ""))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def shown(t: Column) -> Column:
        width = F.array_max(F.transform(t, lambda r: F.size(r)))
        padded = F.transform(t, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        head = F.transform(padded[0], lambda x, i: F.when(x == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(x))
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
        body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
        return F.array_join(F.concat(F.array(line(head), rule), body), "\n")

    return let(clean, lambda t: F.when(F.size(t) == 0, "").otherwise(shown(t)))


# What begins a heading, a code block, a table's rule, a quotation and a list item.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE, RULE, QUOTE, LIST = r"^\s*(`{3}|~{3})\s*(\S*)", r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$", r"^\s*>", r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
BLOCK = "document_id long, block_index int, block_type string, text string, start_char int, end_char int, level int, heading_path array<string>, language string"


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Markdown documents (document_id, text) as typed blocks with offsets, heading path and code language.

    A document is read line by line in an Arrow batch, as each line's meaning depends on the block that is open.
    """
    import re

    heading, fence, rule, quote, item = map(re.compile, (HEADING, FENCE, RULE, QUOTE, LIST))

    def kind_of(all_lines: list[str], i: int) -> str:
        line = all_lines[i]
        if fence.match(line):
            return "code"
        if heading.match(line.strip()):
            return "heading"
        if "|" in line and i + 1 < len(all_lines) and rule.match(all_lines[i + 1].strip()):
            return "table"
        return "blockquote" if quote.match(line) else "list" if item.match(line) else "paragraph" if line.strip() else "blank"

    def read(text: str) -> Iterator[tuple]:
        all_lines = text.split("\n")
        starts = [0]
        for line in all_lines:
            starts.append(starts[-1] + len(line) + 1)
        path: list[str | None] = [None] * 6
        i = 0
        while i < len(all_lines):
            kind, first, level, language = kind_of(all_lines, i), i, None, None
            i += 1
            if kind == "blank":
                continue
            if kind == "code":
                mark, language = fence.match(all_lines[first]).groups()
                while i < len(all_lines) and not all_lines[i].lstrip().startswith(mark):
                    i += 1
                i = min(i + 1, len(all_lines))
            elif kind == "heading":
                marks, title = heading.match(all_lines[first].strip()).groups()
                level = len(marks)
                path[level - 1 :] = [title] + [None] * (6 - level)
            elif kind == "table":
                while i < len(all_lines) and all_lines[i].strip() and "|" in all_lines[i]:
                    i += 1
            else:
                while i < len(all_lines) and kind_of(all_lines, i) == kind:
                    i += 1
            body = "\n".join(all_lines[first:i])
            yield kind, body, starts[first], starts[first] + len(body), level, [p for p in path if p], language or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for doc, text in zip(batch.column("document_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [(doc, k, *b) for k, b in enumerate(read(text or ""))]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("document_id", "text").mapInArrow(run, BLOCK)

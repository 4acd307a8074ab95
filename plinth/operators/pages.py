"""Pages of positioned words: reading order, columns, tables, captions, and the blocks that come of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import let, strip, tokens
from plinth.operators.parse import edge_sides, edge_text, malformed_table, serialize_table, short_edge
from plinth.sources.shared import stored

#: Distance within which words share a line, and gap that splits a line.
SAME_LINE, GAP = 3.0, 120.0
#: Smallest gap between columns, and where it may lie, as shares of the page's width; lines that each column needs.
COLUMN_GAP, LEFTMOST, RIGHTMOST, COLUMN_LINES = 0.12, 0.2, 0.8, 2
#: Lines at either end of a page that may be its header or footer; the white space of ``strip``, and words of pages that one step takes.
EDGE, BLANKS, STEP_WORDS = 2, " \t\n\x0b\f\r\x85\xa0\x1c\x1d\x1e\x1f\u2028\u2029\u3000", 1 << 18


def reading_lines(words: DataFrame) -> DataFrame:
    """Words (document_id, page, x0, x1, top, text) as lines (document_id, page, line_index, top, x0, text).

    A word, in (top, x0) order, joins the line before it where it stands within SAME_LINE of the mean top of that line's words so far;
    a gap wider than GAP within a line begins another. Blank words are left out. Words of one top share their line: once the first is in it,
    the mean only comes nearer. So the tops of a page are folded, not its words, in one row; lines are then cut in a row each.
    """
    page = ["document_id", "page"]
    text = strip(F.col("text"))
    kept = words.withColumn("text", text).where("text <> ''").repartition(*page)  # one exchange serves all that follows
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def add(seen: Column, t: Column) -> Column:
        joins = (seen["n"] > 0) & (F.abs(t["top"] - seen["sum"] / F.greatest(seen["n"], F.lit(1))) <= SAME_LINE)
        line = seen["line"] + F.when(joins, 0).otherwise(1)
        n, total = (F.when(joins, seen[k]).otherwise(0) for k in ("n", "sum"))
        return F.struct((n + F.size(t["words"])).alias("n"), (total + t["top"] * F.size(t["words"])).cast("double").alias("sum"), line.alias("line"), F.concat(seen["lines"], F.array(line)).alias("lines"))

    rows = kept.groupBy(*page, "top").agg(F.collect_list(F.struct("x0", "text", "x1", "top")).alias("words"))
    rows = rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("top", "words"))).alias("tops"))
    rows = rows.withColumn("lines", F.aggregate("tops", none, add)["lines"])
    rows = rows.select(*page, "tops", "lines", F.explode(F.array_distinct("lines")).alias("line"))
    first = F.array_position("lines", F.col("line"))
    own = F.slice("tops", first.cast("int"), F.size(F.filter("lines", lambda x: x == F.col("line"))))
    rows = rows.select(*page, "line", F.sort_array(F.flatten(F.transform(own, lambda t: t["words"]))).alias("w"))

    def pieces(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w))
        starts = F.filter(at, lambda i: (i == 1) | (F.element_at(w, i)["x0"] - F.element_at(w, F.greatest(i - 1, F.lit(1)))["x1"] > GAP))
        return let(starts, lambda s: F.transform(s, lambda b, k: F.slice(w, b, F.coalesce(F.get(s, k + 1), F.size(w) + 1) - b)))

    rows = rows.select(*page, "line", F.posexplode(pieces(F.col("w"))).alias("piece", "w"))
    index = F.row_number().over(Window.partitionBy(*page).orderBy("line", "piece")) - 1
    top, last = F.array_min("w.top").alias("top"), F.array_max("w.x1").alias("x1")
    return rows.select(*page, index.alias("line_index"), top, F.col("w")[0]["x0"].alias("x0"), last, F.array_join("w.text", " ").alias("text"))


def packed(words: DataFrame) -> DataFrame:
    """Words (document_id, page, x0, x1, top, text) as pages (document_id, page, words), each whole in one row."""
    return words.groupBy("document_id", "page").agg(F.collect_list(F.struct("x0", "x1", "top", "text")).alias("words"))


def packed_lines(pages: DataFrame, width: float) -> DataFrame:
    """Pages (document_id, page, words), each whole in one row, with ``lines`` in place of their words: what ``reading_lines`` makes of
    these, in the order of ``column_order``, as structs (line_index, column, top, text). Pages without lines are left out. Nothing is
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                row, lines = _lines_of_pages(part.column("words"), width)
                yield pa.RecordBatch.from_arrays([part.column("document_id").take(row), part.column("page").take(row), lines], ["document_id", "page", "lines"])

    kind = {n: pages.schema[n].dataType.simpleString() for n in ("document_id", "page")}
    own = pages.select("document_id", "page", F.col("words").cast("array<struct<x0:double,x1:double,top:double,text:string>>").alias("words"))
    return own.mapInArrow(run, f"document_id {kind['document_id']}, page {kind['page']}, lines array<struct<line_index:int,column:int,top:double,text:string>>")


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of pages with about STEP_WORDS words each; a longer page is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("words")), 0)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + STEP_WORDS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _lines_of_pages(words: pa.ListArray, width: float) -> tuple[pa.Array, pa.Array]:
    """Numbers of the pages that have lines, and their lines in reading order."""
    page = np.repeat(np.arange(len(words)), np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
    x0, x1, top, text = words.flatten().flatten()
    text = pc.utf8_trim(text, BLANKS)
    held = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(text), 0), False)))
    page, text = page[held], text.take(pa.array(held))
    x0, x1, top = (np.asarray(pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False))[held] for c in (x0, x1, top))
    order = np.lexsort((top, page))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(page[order]) > 0) | (top[order][1:] != top[order][:-1])
    starts = np.flatnonzero(fresh)
    # Words of one top share their line, so tops are folded: each joins the line before where it is near the mean of that line's words.
    line, own, last, n, total = np.zeros(len(starts), np.int64), -1, -1, 0, 0.0
    for i, (p, t, size) in enumerate(zip(page[order][starts].tolist(), top[order][starts].tolist(), np.diff(np.append(starts, len(order))).tolist(), strict=True)):
        if p != last or not abs(t - total / n) <= SAME_LINE:
            own, n, total = own + 1, 0, 0.0
        n, total, last, line[i] = n + size, total + t * size, p, own
    of_word = np.empty(len(order), np.int64)
    of_word[order] = np.repeat(line, np.diff(np.append(starts, len(order))))
    order = np.lexsort((x0, of_word))
    if np.any((np.diff(of_word[order]) == 0) & (np.diff(x0[order]) == 0)):  # only then does the text decide
        order = np.lexsort((top, x1, np.asarray(pc.rank(text.cast(pa.binary()), tiebreaker="dense")), x0, of_word))
    page, x0, x1, top, of_word = page[order], x0[order], x1[order], top[order], of_word[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(of_word) > 0) | (x0[1:] - x1[:-1] > GAP)
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return pa.array([], pa.int64()), pa.array([], pa.list_(_LINE))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), text.take(pa.array(order))), " ")
    top, x0 = np.minimum.reduceat(top, starts), x0[starts]
    rows, firsts, row = np.unique(page[starts], return_index=True, return_inverse=True)
    column = _columns(row, x0, width)
    order = np.lexsort((x0, top, column, row))
    index = np.arange(len(row)) - firsts[row]
    values = pa.array(index[order], pa.int32()), pa.array(column[order], pa.int32()), pa.array(top[order]), joined.take(pa.array(order))
    return pa.array(rows), pa.ListArray.from_arrays(pa.array(np.append(firsts, len(row)), pa.int32()), pa.StructArray.from_arrays(values, fields=list(_LINE)))


_LINE = pa.struct([("line_index", pa.int32()), ("column", pa.int32()), ("top", pa.float64()), ("text", pa.string())])


def _columns(page: np.ndarray, x0: np.ndarray, width: float) -> np.ndarray:
    """0, or 1 for lines in the right of two columns, as in ``column_order``; pages are numbered from 0 and come in order."""
    order = np.lexsort((x0, page))
    a, b, same = x0[order][:-1], x0[order][1:], np.diff(page[order]) == 0
    a, b, of = a[same], b[same], page[order][1:][same]
    by_gap = np.lexsort((-b, b - a, of))
    last = by_gap[np.append(np.diff(of[by_gap]) > 0, True)] if len(of) else by_gap  # each page's widest gap, of equal ones the leftmost
    gap, middle = np.full(page.max() + 1, -np.inf), np.full(page.max() + 1, np.inf)
    gap[of[last]], middle[of[last]] = (b - a)[last], ((b + a) / 2)[last]
    right = np.bincount(page, x0 > middle[page], len(gap))
    enough = (right >= COLUMN_LINES) & (np.bincount(page, minlength=len(gap)) - right >= COLUMN_LINES)
    two = (gap >= COLUMN_GAP * width) & (middle >= LEFTMOST * width) & (middle <= RIGHTMOST * width) & enough
    return (two[page] & (x0 > middle[page])).astype(np.int64)


def column_order(lines: DataFrame, width: float) -> DataFrame:
    """Lines with ``column`` (0, or 1 for the right of two) and their place in reading order.

    A page has two columns where the widest gap between the left edges of its lines is wide and central enough and both sides have lines.
    """
    page = ["document_id", "page"]
    left = Window.partitionBy(*page).orderBy("x0")
    both = Window.partitionBy(*page)
    gap = F.struct((F.col("x0") - F.col("before")).alias("gap"), -F.col("x0"), ((F.col("x0") + F.col("before")) / 2).alias("middle"))
    sides = lines.withColumn("before", F.lag("x0").over(left)).withColumn("g", F.max(F.when(F.col("before").isNotNull(), gap)).over(both))
    sides = sides.withColumn("right", F.coalesce(F.col("x0") > F.col("g.middle"), F.lit(False)))
    enough = (F.count_if("right").over(both) >= COLUMN_LINES) & (F.count_if(~F.col("right")).over(both) >= COLUMN_LINES)
    two = (F.col("g.gap") >= COLUMN_GAP * width) & F.col("g.middle").between(LEFTMOST * width, RIGHTMOST * width) & enough
    sides = sides.withColumn("column", F.when(F.coalesce(two, F.lit(False)) & F.col("right"), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy(*page).orderBy("column", "top", "x0")) - 1
    return sides.select(*page, "line_index", "column", place.alias("place"), "text")


def outside_tables(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines (document_id, page, line_index, text) that don't repeat a table row (document_id, page, text), or all rows of their page.

    A line repeats the rows together where at least two of its tokens, and four fifths of them, stand in them; it repeats one row where
    two are shared, and these are four fifths of either side.
    """
    found = lines.withColumn("own", F.array_distinct(tokens(F.col("text")))).join(_token_sets(rows), ["document_id", "page"], "left")
    return found.where(F.col("rows").isNull() | ~_repeats(F.col("own"), F.col("rows"), F.col("every"))).select(*lines.columns)


def _token_sets(rows: DataFrame) -> DataFrame:
    """document_id, page, ``rows``, the sets of tokens of its table rows, and ``every``, the set of all."""
    sets = F.collect_set(F.array_sort(F.array_distinct(tokens(F.col("text")))))
    return rows.groupBy("document_id", "page").agg(sets.alias("rows")).withColumn("every", F.array_distinct(F.flatten("rows")))


def _repeats(own: Column, rows: Column, every: Column) -> Column:
    """Whether a line with these tokens repeats the rows together, or one of them."""

    def enough(other: Column, also: Callable[[Column], Column]) -> Column:
        return let(F.size(F.array_intersect(own, other)), lambda n: (n >= 2) & (n >= 0.8 * F.size(own)) & also(n))

    one = F.exists(rows, lambda r: (F.size(r) >= 2) & enough(r, lambda n: n >= 0.8 * F.size(r)))
    return (F.size(own) >= 2) & (enough(every, lambda _: F.lit(True)) | one)


# How the caption of a table begins.
CAPTION = r"(?i)^\s*(table\s+[0-9]+[:.]?|table\s+[ivxlcdm]+[:.]?|表\s*[0-9]+[:.]?)."


def captions(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables (document_id, page, table_index, top) with ``caption``: the nearest caption line above the table, or the first of its page
    where the table has no position (a null top)."""
    found = lines.where(F.col("text").rlike(CAPTION)).select("document_id", "page", "line_index", F.col("top").alias("line_top"), F.col("text").alias("line"))
    near = tables.join(found, ["document_id", "page"]).where("top is null or line_top < top")
    key = F.struct(F.when(F.col("top").isNotNull(), F.col("line_top")), -F.col("line_index"))
    near = near.groupBy("document_id", "page", "table_index").agg(F.max_by("line", key).alias("caption"))
    return tables.join(near, ["document_id", "page", "table_index"], "left")


def page_tables(positioned: DataFrame, plain: DataFrame) -> DataFrame:
    """The tables of pages, serialised: those with a position (document_id, page, table_index, top, rows), on pages without any the plain
    ones (without top). Tables without content are left out; ``malformed`` marks those with rows of different lengths."""
    others = plain.join(positioned.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").withColumn("top", F.lit(None).cast("double"))
    both = positioned.withColumn("top", F.col("top").cast("double")).unionByName(others.select(*positioned.columns))
    shown = both.withColumns({"text": serialize_table(F.col("rows")), "malformed": malformed_table(F.col("rows"))})
    return shown.where("text <> ''").select("document_id", "page", "table_index", "top", "text", "malformed")


def page_text(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page, words_text, plain_text) with ``text``, and ``fallback`` where the words gave none."""
    blank = F.coalesce(F.trim("words_text"), F.lit("")) == ""
    return pages.select("document_id", "page", F.when(blank, F.coalesce("plain_text", F.lit(""))).otherwise(F.col("words_text")).alias("text"), blank.alias("fallback"))


def page_blocks(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """A paragraph block for each page with text, then its tables, each after its caption and an empty line; numbered through the document."""
    return numbered_parts(page_parts(pages, tables)).select("document_id", "block_index", "page", "block_type", "text")


def page_parts(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """The blocks of ``page_blocks`` before they are numbered: document_id, page, part, block_type, text."""
    kinds = "document_id", "page", "part", "block_type", "text"
    body = pages.where(F.trim("text") != "").withColumns({"part": F.lit(-1), "block_type": F.lit("paragraph")}).select(*kinds)
    shown = F.concat_ws("\n\n", F.nullif("caption", F.lit("")), "text")
    return body.unionByName(tables.withColumns({"part": F.col("table_index"), "block_type": F.lit("table"), "text": shown}).select(*kinds))


def numbered_parts(parts: DataFrame) -> DataFrame:
    """Parts of pages with ``block_index``, by page and part through each document; all their columns are shuffled, so it is best given few."""
    return parts.withColumn("block_index", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "part")) - 1)


def page_warnings(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page, warning) of pages (document_id, page, text, fallback) that have neither text nor a table, or only their plain
    text, and of tables whose rows differ in length."""
    bare = pages.where(F.trim("text") == "").join(tables.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    parts = [(bare, "empty page"), (pages.where(F.col("fallback") & (F.trim("text") != "")), "no words"), (tables.where("malformed"), "malformed table")]
    out = [rows.select("document_id", "page", F.lit(w).alias("warning")) for rows, w in parts]
    return out[0].union(out[1]).union(out[2])


def document_text(blocks: DataFrame) -> DataFrame:
    """document_id and the text of its blocks, joined by empty lines."""
    parts = F.sort_array(F.collect_list(F.struct("block_index", "text")))
    return blocks.where("text <> ''").groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def read_pages(words: DataFrame, tables: DataFrame, rows: DataFrame, plain: DataFrame, width: float) -> DataFrame:
    """Blocks of paged documents, from positioned words to numbered blocks.

    words: (document_id, page, x0, x1, top, text); the rest as in ``parts_of_pages``.
    """
    return numbered_parts(parts_of_pages(packed(words), tables, rows, plain, width)).select("document_id", "block_index", "page", "block_type", "text")


def parts_of_pages(pages: DataFrame, tables: DataFrame, rows: DataFrame, plain: DataFrame, width: float) -> DataFrame:
    """What ``page_parts`` gives for paged documents.

    pages: (document_id, page, words), each page whole in one row; tables: as ``page_tables`` gives them; rows: their rows' texts
    (document_id, page, text); plain: (document_id, page, plain_text), one for each page, for pages whose words give nothing. Words become
    lines in reading order, headers and footers go, then lines that repeat a table; the rest of a page is its paragraph.

    A page stays one row: its lines are made and ordered where its words are, stored without positions, and shuffled once, to what is known
    of the page. Only the lines at its edges are looked at apart.
    """
    page = ["document_id", "page"]
    read = packed_lines(pages, width)
    found = F.filter("lines", lambda x: (F.contains(F.lower(x["text"]), F.lit("table")) | F.contains(x["text"], F.lit("表"))) & x["text"].rlike(CAPTION))
    # A page is one string, which takes less room than its lines; those of one that holds line feeds within lines stay apart.
    apart = F.when(F.exists("lines", lambda x: F.contains(x["text"], F.lit("\n"))), F.col("lines.text"))
    size = F.size("lines")
    ends = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i < EDGE) | (i >= size - EDGE))
    ends = F.transform(ends, lambda i: F.struct(i.alias("line_index"), F.when(i < EDGE, "header").otherwise("footer").alias("place"), edge_text(F.get("lines", i)["text"]).alias("norm")))
    ends = F.filter(ends, lambda x: short_edge(x["norm"]))
    lines = stored(read.select(*page, F.array_join("lines.text", "\n").alias("whole"), apart.alias("apart"), found.alias("found"), ends.alias("ends")), "lines")
    single = F.coalesce("apart", F.split("whole", "\n"))
    edges = lines.select(*page, F.explode("ends").alias("x")).select(*page, "x.*")
    gone = edges.join(edge_sides(edges, lines), ["document_id", "norm"]).where(F.col("where") == F.col("place")).groupBy(*page).agg(F.collect_list("line_index").alias("gone"))
    known = plain.join(lines.select(*page, "whole", "apart"), page, "left").join(gone, page, "left").join(_token_sets(rows), page, "left")
    kept = F.filter(single, lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    outside = F.filter(kept, lambda x: ~let(F.array_distinct(tokens(x)), lambda own: _repeats(own, F.col("rows"), F.col("every"))))
    text = F.when(F.col("rows").isNotNull(), F.array_join(outside, "\n")).when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("whole"))
    plain_text = F.when(F.col("whole").isNotNull(), "").otherwise(F.col("plain_text"))
    texts = page_text(known.select(*page, F.explode(F.array(text)).alias("words_text"), plain_text.alias("plain_text")))  # explode: made once, not again by each filter
    captioned = lines.where(F.size("found") > 0).select(*page, F.explode("found").alias("x")).select(*page, "x.line_index", "x.top", "x.text")
    return page_parts(texts, captions(tables, captioned))

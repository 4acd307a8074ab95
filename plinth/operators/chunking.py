"""Chunks from documents and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import let
from plinth.operators.numbering import running
from plinth.sources.shared import sent, stored


#: What blocks may have besides, and blocks of a document from which it is packed by many tasks.
MORE, LARGE = ("page_number", "heading_path", "level", "warnings", "media_type", "formula_lines", "removed_lines"), 100_000
#: Characters of a stretch of a large document in which a task looks for the ends of chunks.
STRETCH = 1 << 20


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk needs a positive size, and an overlap from 0 to below it")


def chunk_name(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::chunk-"), F.lpad(index.cast("string"), F.greatest(F.lit(4), F.length(index.cast("string"))), F.lit("0")))


def sliding_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters, one every ``size - overlap`` until the text ends; the tail of an overlap is a chunk too."""
    check_sizes(size, overlap)
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap)))
    rows = docs.select("document_id", "source_path", "text", F.posexplode(starts).alias("chunk_index", "start_char"))
    text = F.substring("text", F.col("start_char") + 1, F.lit(size))
    rows = rows.withColumn("chunk_text", text)
    return rows.select(
        chunk_name(F.col("source_path"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "source_path",
        "chunk_index",
        "start_char",
        (F.col("start_char") + F.length("chunk_text")).alias("end_char"),
        F.col("chunk_text").alias("text"),
    )


def split_oversized(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Texts longer than ``size`` cut into overlapping pieces; the last piece is the one that reaches the end."""
    check_sizes(size, overlap)
    step = size - overlap
    pieces = F.ceil((F.length("text") - size) / F.lit(float(step))).cast("int")
    rows = docs.where(F.length("text") > size).select("document_id", "text", F.posexplode(F.sequence(F.lit(0), pieces)).alias("piece", "k"))
    start = F.col("k") * step
    return rows.select("document_id", "piece", start.alias("start_char"), F.least(start + size, F.length("text")).alias("end_char"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def block_chunks(blocks: DataFrame, size: int = 1000, overlap: int = 0, split: bool = True) -> DataFrame:
    """Blocks (document_id, block_index, block_type, text, start_char, end_char) packed in order into chunks.

    Text is joined by an empty line; a chunk ends before it would pass ``size``; a table stands alone, whole; another block longer than
    ``size`` is cut into overlapping pieces, each a chunk with its own range, unless ``split`` is off; empty blocks are left out.
    ``exceeds`` marks chunks longer than ``size``. A document's blocks are folded in one row, so nothing but that document is gathered.
    Where blocks have them, page_number becomes page_start and page_end, heading_path the first that isn't empty, level the only one
    there is, warnings all in order, media_type the first, formula_lines those that stand in the chunk, ten at most, removed_lines the sum.
    """
    check_sizes(size, overlap)
    more = [c for c in MORE if c in blocks.columns]
    block = F.struct("block_index", "block_type", "text", "start_char", "end_char", *more)
    kept = blocks.where(F.length("text") > 0).groupBy("document_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    chunk = "struct<n:int,alone:boolean,from:int,to:int>"
    none = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))

    def add(seen: Column, i: Column, all_blocks: Column) -> Column:
        b = F.element_at(all_blocks, i)
        n = F.length(b["text"])
        alone = (b["block_type"] == "table") | (n > size)
        fits = seen["open"].isNotNull() & ~seen["open"]["alone"] & ~alone & (seen["open"]["n"] + 2 + n <= size)
        fresh = F.struct(n.alias("n"), alone.alias("alone"), i.alias("from"), i.alias("to"))
        grown = F.struct((seen["open"]["n"] + 2 + n).alias("n"), F.lit(False).alias("alone"), seen["open"]["from"].alias("from"), i.alias("to"))
        closed = F.when(fits | seen["open"].isNull(), seen["done"]).otherwise(F.concat(seen["done"], F.array(seen["open"])))
        return F.struct(closed.alias("done"), F.when(fits, grown).otherwise(fresh).alias("open"))

    def pack(all_blocks: Column) -> Column:
        state = F.aggregate(F.sequence(F.lit(1), F.size(all_blocks)), none, lambda s, i: add(s, i, all_blocks))
        return let(state, lambda s: F.concat(s["done"], F.array(s["open"])))

    def cut(c: Column, all_blocks: Column) -> Column:
        """A chunk, or the pieces of one that is a single long block: where they begin in its text; null for the whole."""
        long = F.lit(split) & c["alone"] & (F.element_at(all_blocks, c["from"])["block_type"] != "table")
        pieces = F.sequence(F.lit(0), F.ceil((c["n"] - size) / F.lit(float(size - overlap))).cast("int"))
        whole = F.array(F.struct(c["from"].alias("from"), c["to"].alias("to"), F.lit(None).cast("int").alias("at")))
        return F.when(long, F.transform(pieces, lambda k: F.struct(c["from"].alias("from"), c["to"].alias("to"), (k * (size - overlap)).alias("at")))).otherwise(whole)

    chunks = kept.withColumn("chunks", let(F.col("blocks"), lambda b: F.flatten(F.transform(pack(b), lambda c: cut(c, b)))))
    chunks = chunks.select("document_id", "blocks", F.posexplode("chunks").alias("chunk_index", "c"))
    part = F.slice("blocks", F.col("c.from"), F.col("c.to") - F.col("c.from") + 1)
    return _shown(chunks.select("document_id", "chunk_index", F.col("c.at").alias("at"), part.alias("p")), more, size)


def _shown(rows: DataFrame, more: list[str], size: int) -> DataFrame:
    """Chunks with their blocks in the array ``p``, and where a piece of a long block begins in its text (``at``), as they are handed on."""
    joined = F.array_join(F.transform("p", lambda b: b["text"]), "\n\n")
    rows = rows.withColumn("text", F.when(F.col("at").isNull(), joined).otherwise(F.substring(F.col("p")[0]["text"], F.col("at") + 1, F.lit(size))))
    first = F.array_min(F.transform("p", lambda b: b["start_char"])) + F.coalesce("at", F.lit(0))
    last = F.when(F.col("at").isNull(), F.array_max(F.transform("p", lambda b: b["end_char"]))).otherwise(first + F.length("text"))
    return rows.select(
        "document_id",
        "chunk_index",
        "text",
        first.alias("start_char"),
        last.alias("end_char"),
        F.array_distinct(F.transform("p", lambda b: b["block_type"])).alias("block_types"),
        (F.size("p") == 1).alias("single"),
        (F.length("text") > size).alias("exceeds"),
        *_rolled_up(more),
    )


def block_chunks_of_any_size(blocks: DataFrame, size: int = 1000, overlap: int = 0, split: bool = True, large: int = LARGE) -> DataFrame:
    """As ``block_chunks``; documents of more than ``large`` blocks are packed by many tasks at once, the others folded in a row each."""
    check_sizes(size, overlap)
    kept = stored(blocks.where(F.length("text") > 0).withColumn("__row", F.monotonically_increasing_id()), "blocks")
    counts = stored(kept.groupBy("document_id").agg(F.count("*").alias("n")), "counts")
    huge = counts.where(F.col("n") > large).select("document_id")
    if huge.isEmpty():
        return block_chunks(kept.drop("__row"), size, overlap, split)
    if counts.where(F.col("n") <= large).isEmpty():
        return _packed_in_parallel(kept, kept, size, overlap, split)
    few = sent(huge)
    small = block_chunks(kept.drop("__row").join(few, "document_id", "left_anti"), size, overlap, split)
    return small.unionByName(_packed_in_parallel(kept, kept.join(few, "document_id"), size, overlap, split))


def _packed_in_parallel(blocks: DataFrame, among: DataFrame, size: int, overlap: int, split: bool) -> DataFrame:
    """Chunks of documents of any number of blocks, whose texts aren't empty; of all ``blocks``, those ``among`` them, by their ``__row``.

    Where a chunk that begins with a block would end depends on the blocks within ``size`` characters alone: stretches of a document, with
    so much of the next, are looked at by themselves. Which blocks do begin chunks is found by doubling: from the starts known so far
    to those a jump on, where jumps lead over one chunk, then two, four, ... No task holds a document. Texts stay behind until the numbers
    of their chunks are known. The numbers are stored compressed, so files say little of their rows: joins merge them, none is sent.
    """
    doc, more = ["document_id"], [c for c in MORE if c in blocks.columns]
    alone = (F.col("block_type") == "table") | (F.length("text") > size)
    rows = among.select(*doc, "block_index", "__row", alone.alias("__alone"), F.lit(1).alias("__one"), (F.length("text") + 2).alias("__wide"))
    rows = stored(running(rows, doc, ["block_index", "__row"], {"__k": "__one", "__a": "__wide"}), "placed")
    places = rows.select(*doc, "__k", "__a", "__alone")
    ends = rows.groupBy(*doc).agg(F.count("*").alias("__k"), F.sum("__wide").cast("long").alias("__a")).withColumn("__alone", F.lit(True))
    places = places.unionByName(ends).withColumn("__home", F.floor(F.col("__a") / STRETCH))
    near = F.when((F.col("__home") > 0) & (F.col("__a") % STRETCH <= size + 2), F.array("__home", F.col("__home") - 1)).otherwise(F.array("__home"))
    reach = Window.partitionBy(*doc, "__stretch").orderBy("__a").rangeBetween(1, size + 2)
    last, alone = F.max("__k").over(reach), F.min(F.when(F.col("__alone"), F.col("__k"))).over(reach)
    following = F.when(F.col("__alone"), F.col("__k") + 1).otherwise(F.least(F.coalesce(last, F.col("__k") + 1), alone))
    jumps = places.select("*", F.explode(near).alias("__stretch")).withColumn("__next", following).where("__stretch = __home")
    jumps = jumps.join(ends.select(*doc, F.col("__k").alias("__n")).hint("merge"), doc)
    jumps = stored(jumps.select(*doc, "__k", F.least("__next", "__n").alias("__next")), "jumps")
    begun = stored(ends.select(*doc, F.lit(0).cast("long").alias("__k")), "begun")
    known = begun.count()
    while True:
        further = begun.join(jumps.hint("merge"), [*doc, "__k"]).select(*doc, F.col("__next").alias("__k"))
        begun = stored(begun.union(further).distinct(), "begun")
        if (n := begun.count()) == known:
            break
        known = n
        over = jumps.select(*doc, F.col("__k").alias("__next"), F.col("__next").alias("__over"))
        jumps = stored(jumps.join(over.hint("merge"), [*doc, "__next"]).select(*doc, "__k", F.col("__over").alias("__next")), "jumps")
    flagged = rows.select(*doc, "__k", "__row").join(begun.withColumn("__start", F.lit(1)).hint("merge"), [*doc, "__k"], "left").fillna(0, ["__start"])
    flagged = running(flagged, doc, ["__k"], {"__before": "__start"}).withColumn("__chunk", F.col("__before") + F.col("__start"))
    block = F.struct("block_index", "block_type", "text", "start_char", "end_char", *more)
    chunks = blocks.join(flagged.select("__row", "__chunk").hint("merge"), "__row").groupBy(*doc, "__chunk").agg(F.sort_array(F.collect_list(block)).alias("p"))  # within size characters, or one block
    only = F.col("p")[0]
    cut = F.lit(split) & (F.size("p") == 1) & (only["block_type"] != "table") & (F.length(only["text"]) > size)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(only["text"]) - size) / F.lit(float(size - overlap))).cast("int"), F.lit(0)))
    starts = F.when(cut, F.transform(pieces, lambda k: k * (size - overlap))).otherwise(F.array(F.lit(None).cast("int")))
    chunks = running(chunks.withColumns({"__starts": starts, "__pieces": F.size(starts)}), doc, ["__chunk"], {"__index": "__pieces"})
    each = chunks.select(*doc, "p", "__index", F.posexplode("__starts").alias("__piece", "at"))
    return _shown(each.select(*doc, (F.col("__index") + F.col("__piece")).cast("int").alias("chunk_index"), "at", "p"), more, size)


def _rolled_up(names: list[str]) -> list[Column]:
    """What the blocks of a chunk, in the array ``p``, say together."""
    out = []
    if "page_number" in names:
        pages = F.transform("p", lambda b: b["page_number"])
        out += [F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end")]
    if "heading_path" in names:
        out.append(F.get(F.filter(F.transform("p", lambda b: b["heading_path"]), lambda x: F.size(x) > 0), F.lit(0)).alias("heading_path"))
    if "level" in names:
        levels = F.array_distinct(F.filter(F.transform("p", lambda b: b["level"]), lambda x: x.isNotNull()))
        out.append(F.when(F.size(levels) == 1, levels[0]).alias("level"))
    if "media_type" in names:
        out.append(F.get(F.filter(F.transform("p", lambda b: b["media_type"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)).alias("media_type"))
    if "formula_lines" in names:
        all_ = F.flatten(F.transform("p", lambda b: F.coalesce(b["formula_lines"], F.array().cast("array<string>"))))
        out.append(F.slice(F.filter(all_, lambda x: F.contains(F.col("text"), x)), 1, 10).alias("formula_lines"))
    if "removed_lines" in names:
        out.append(F.aggregate("p", F.lit(0), lambda n, b: n + F.coalesce(b["removed_lines"], F.lit(0)).cast("int")).alias("removed_lines"))
    if "warnings" in names:
        out.append(F.flatten(F.transform("p", lambda b: F.coalesce(b["warnings"], F.array().cast("array<string>")))).alias("warnings"))
    return out

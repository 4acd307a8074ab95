"""Paged documents as a data source: partitions by file and range, read by a decoder.

    spark.dataSource.register(PagedSource)
    words = spark.read.format("paged_words").option("path", folder).load()

gives positioned words (document_id, page, x0, x1, top, text); with the option
``packed`` a row for each page that has words: document_id, page and its words, an array
of structs (x0, x1, top, text). Files are listed once, and each is divided into ranges
as its decoder says: pages, where the format lets them be reached, or bytes. A task opens
one file and decodes one range, so a long document is read by many tasks and no task
holds more than a range's page at a time. Compressed files (.gz, .bz2, .zst, .lz4) can't
be entered in the middle: each is one range, so they are best written small. The decoder is named by the option ``decoder`` ("module:class"); the default
reads JSON lines, a page each:

    {"document_id": 7, "page": 0, "words": [[0.0, 30.0, 12.0, "Title"], ...]}

or with the words' values side by side, which takes less room when compressed:

    {"document_id": 7, "page": 0, "x0": [0.0, ...], "x1": [30.0, ...], "top": [12.0, ...], "text": ["Title", ...]}

A decoder of another format (PDF, say, where a library for it is installed) is a
class with ``ranges`` and ``pages`` like JsonPages. Defined results: an empty folder
gives no rows; blank lines are passed over; a page without words gives none; a line
that isn't a page is an error that names the file.
"""

from __future__ import annotations

import importlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "document_id long, page int, x0 double, x1 double, top double, text string"
PACKED = "document_id long, page int, words array<struct<x0:double,x1:double,top:double,text:string>>"
_ARROW = pa.schema([("document_id", pa.int64()), ("page", pa.int32()), ("x0", pa.float64()), ("x1", pa.float64()), ("top", pa.float64()), ("text", pa.string())])
_WORD = pa.struct([f for f in _ARROW if f.name not in ("document_id", "page")])
_PAGES = pa.schema([_ARROW.field("document_id"), _ARROW.field("page"), ("words", pa.list_(_WORD))])
#: Bytes of a range of a file of JSON lines; words of a batch; bytes read at once.
RANGE_BYTES, BATCH, READ_BYTES = 8 << 20, 1 << 15, 1 << 18
#: How the names of compressed files end, and where the only range of one does.
COMPRESSED, ENDLESS = (".gz", ".bz2", ".zst", ".lz4"), 1 << 62


class Columns(NamedTuple):
    """The words of a page, their values side by side."""

    x0: list
    x1: list
    top: list
    text: list


class JsonPages:
    """Pages as JSON lines; a range holds the lines that begin in it."""

    def ranges(self, size: int, step: int) -> list[tuple[int, int]]:
        """Ranges (first, last + 1) of a file of so many bytes."""
        return [(at, min(at + step, size)) for at in range(0, size, step)]

    def pages(self, file: pa.NativeFile, first: int, end: int) -> Iterator[tuple[int, int, list]]:
        """document_id, page and words (a list of (x0, x1, top, text), or Columns) of the pages of a range."""
        lines, at = io.BufferedReader(file, READ_BYTES), 0
        if first:
            lines.seek(first - 1)
            at = first - 1 + len(lines.readline())  # the rest of a line that began before; one line feed where the range begins with a line
        while at < end and (line := lines.readline()):
            at += len(line)
            if line.strip():
                page = json.loads(line)
                yield page["document_id"], page["page"], page["words"] if "words" in page else Columns(*(page[f.name] for f in _WORD))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the option path names the folder or file")
        self.path, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        module, _, name = options.get("decoder", f"{__name__}:{JsonPages.__name__}").partition(":")
        self.decoder = getattr(importlib.import_module(module), name)()
        self.packed = _packed(options)

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(root)
        listed = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in listed if f.is_file and not any(part.startswith(("_", ".")) for part in f.path[len(root) :].split("/"))), key=lambda f: f.path)
        ranges = ((f, [(0, ENDLESS)] if f.path.endswith(COMPRESSED) else self.decoder.ranges(f.size, self.step)) for f in files)
        return [Range(f.path, a, b) for f, own in ranges for a, b in own] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        held = _Pages()
        with system.open_input_stream(partition.path) if partition.path.endswith(COMPRESSED) else system.open_input_file(partition.path) as file:
            try:
                for document_id, page, words in self.decoder.pages(file, partition.first, partition.end):
                    held.add(document_id, page, words)
                    if len(held.text) >= BATCH:
                        yield held.batch(self.packed)
                        held = _Pages()
            except (ValueError, KeyError, TypeError) as wrong:
                raise ValueError(f"{partition.path} holds a line that is no page: {wrong!r}") from wrong
        if held.text:
            yield held.batch(self.packed)


class _Pages:
    """Whole pages, until there are enough words for a batch."""

    def __init__(self):
        self.document_id, self.page, self.size = [], [], []
        self.x0, self.x1, self.top, self.text = [], [], [], []

    def add(self, document_id: int, page: int, words: list | Columns) -> None:
        if not isinstance(words, Columns):
            words = Columns(*zip(*words, strict=True)) if words else Columns([], [], [], [])
        if len({*map(len, words)}) > 1:
            raise ValueError("values of other numbers of words")
        x0, x1, top, text = words
        if not text:
            return
        for own, values in ((self.x0, map(float, x0)), (self.x1, map(float, x1)), (self.top, map(float, top)), (self.text, text)):
            own.extend(values)
        self.document_id.append(document_id)
        self.page.append(page)
        self.size.append(len(text))

    def batch(self, packed: bool) -> pa.RecordBatch:
        words = [pa.array(getattr(self, f.name), f.type) for f in _WORD]
        pages = [pa.array(self.document_id, pa.int64()), pa.array(self.page, pa.int32())]
        size = np.array(self.size)
        if packed:
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            own = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(words, fields=list(_WORD)))
            return pa.RecordBatch.from_arrays([*pages, own], schema=_PAGES)
        at = pa.array(np.repeat(np.arange(len(size)), size))
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in pages), *words], schema=_ARROW)


def _packed(options: dict[str, str]) -> bool:
    return options.get("packed", "false").lower() == "true"


class PagedSource(DataSource):
    """The data source ``paged_words``."""

    @classmethod
    def name(cls) -> str:
        return "paged_words"

    def schema(self) -> str:
        return PACKED if _packed(self.options) else SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

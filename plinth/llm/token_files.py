"""Token ids in binary files: word-aligned Simple-8b blocks.

Documents are dealt into ranges of doc_id, and each range is written in that order
by one task: every text is encoded, an end id is added, and the ids go into files
one after another. A file is

    magic | blocks | footer (Arrow, zstd): doc_id and n of each document, offset, words and wide of each block | size of the footer | ids | magic

A block holds BLOCK_IDS ids (a file's last one fewer) as 64-bit little-endian words
and after them its escapes. The top four bits of a word select how many codes it
packs and how wide each is (SELECTORS). A code is the id plus 1; code 0 stands for
an escape: the id is then the next of the block's escapes, which are 32 bits wide,
or 64 if ``wide``. Ids that need more bits than the block's cap, which is chosen for
the least size, are escapes, so a rare large id doesn't widen its neighbours; ids of
more than 60 bits always are. As blocks have equal numbers of ids and the footer
has their offsets, ids i to j are read by range without the blocks before.

A text is cut where a pre-token must end whatever surrounds it, on the bytes of
a whole batch; each distinct piece is encoded once, while it is remembered, by the
tokenizers library: its model alone where the piece is a single pre-token, the whole
tokenizer elsewhere. Strings of special tokens in a text are ordinary text.

A task that is run again writes other files; only those that the stored manifest
names count. The folder may be in any store that pyarrow's file systems reach.

Defined results: null or empty text has the end id alone; a very long text is
encoded whole, in its row's memory, and read back a few blocks at a time; documents
come by ascending doc_id of any type, null first; repeated rows are written each; an
empty table gives an empty manifest and no file. Other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import io
import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import new_folder, slices, stored, text_of
from plinth.llm.words import bytes_of, strings

VOCABULARY, END = "byte_bpe_50k.json", 0
MAGIC, TAIL = b"PLNTHS8B", "<qq8s"
#: Codes of a word and the bits of each, by selector.
SELECTORS = tuple((n, 60 // n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60))
BLOCK_IDS, FILE_BYTES = 1 << 16, 64 << 20
#: Ids of a block from which its cap is chosen.
SAMPLE = 4096
#: Blocks that are decoded in one step.
STEP = 16
#: Distinct pieces of text of which a worker process keeps the ids, about; and as many older ones.
KNOWN = 1 << 18
MANIFEST = "part long, seq long, file string, n_docs long, n_ids long, n_bytes long"


_SMALL = np.frexp(np.arange(1, (1 << 16) + 1, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value plus 1 needs; one more, at most, near powers of two beyond 2^53."""
    if int(values.max(initial=0)) < len(_SMALL):
        return _SMALL[values]
    return np.frexp(values.astype(np.float64) + 1)[1].astype(np.uint8)


def _layout(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of codes of so many bits (60 at most) begin, and their selectors: each takes as many codes as fit."""
    select, jump = np.zeros(len(bits), np.uint8), np.ones(len(bits), np.uint8)
    widest, before = bits, 1
    for k, (n, width) in enumerate(SELECTORS):
        if n > 1:  # the widest of n codes is the wider of two overlapping windows of as many as before
            ahead = np.zeros_like(widest)
            ahead[: max(0, len(bits) - (n - before))] = widest[n - before :]
            widest, before = np.maximum(widest, ahead), n
            fits = widest <= width
            select[fits], jump[fits] = k, n
    at, places, steps = 0, [], jump.tobytes()
    while at < len(steps):
        places.append(at)
        at += steps[at]
    places = np.array(places, np.int64)
    return places, select[places]


def _cap(bits: np.ndarray) -> int:
    """The width beyond which ids become escapes: the one that packs pieces from all over the block least."""
    piece = np.arange(SAMPLE // 8)
    some = bits if len(bits) <= SAMPLE else bits[(np.arange(8) * ((len(bits) - SAMPLE // 8) // 7))[:, None] + piece].ravel()
    sizes = {}
    for _, width in reversed(SELECTORS):
        escaped = some > width
        if 10 * escaped.sum() <= len(some):
            large = 64 if bits.max() > 32 else 32
            sizes[width] = 64 * len(_layout(np.where(escaped, 1, some).astype(np.uint8))[0]) + large * int(escaped.sum())
        if width >= bits.max():
            break
    return min(sizes, key=lambda w: (sizes[w], -w), default=SELECTORS[0][1])


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escapes of a block of ids (uint64)."""
    bits = _bits(ids)
    escaped = bits > _cap(bits)
    escapes = ids[escaped]
    codes = np.concatenate((np.where(escaped, np.uint64(0), ids + np.uint64(1)), np.zeros(SELECTORS[-1][0], np.uint64)))
    bits[escaped] = 1
    places, select = _layout(bits)
    words = select.astype(np.uint64) << np.uint64(60)
    for k, (n, width) in enumerate(SELECTORS):
        own = np.flatnonzero(select == k)
        if len(own):
            shifts = (np.arange(n) * width).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(codes[places[own][:, None] + np.arange(n)] << shifts, axis=1)
    return words, escapes


def decode_block(words: np.ndarray, escapes: np.ndarray, count: int) -> np.ndarray:
    """The count ids (uint64) of a block."""
    select = (words >> np.uint64(60)).astype(np.intp)
    sizes = np.array([n for n, _ in SELECTORS])[select]
    starts = np.cumsum(sizes) - sizes
    codes = np.empty(int(sizes.sum()), np.uint64)
    for k, (n, width) in enumerate(SELECTORS):
        own = np.flatnonzero(select == k)
        if len(own):
            shifts = (np.arange(n) * width).astype(np.uint64)
            codes[starts[own][:, None] + np.arange(n)] = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
    codes = codes[:count]
    escaped = codes == 0
    codes -= np.uint64(1)
    codes[escaped] = escapes
    return codes


class Writer:
    """One file: documents' ids in order, blocks written as they fill."""

    def __init__(self, file, kind: pa.DataType):
        self.file, self.kind = file, kind
        self.at = self.file.write(MAGIC) and len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.blocks: list[tuple[int, int, bool]] = []

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with so many ids each, which ids holds one after another."""
        self.doc_ids.append(doc_ids)
        self.counts.append(counts.astype(np.int64))
        self.pending.append(ids.astype(np.uint64))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCK_IDS:
            rows = np.concatenate(self.pending)
            whole = len(rows) - len(rows) % BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(rows[k : k + BLOCK_IDS])
            self.pending, self.waiting = [rows[whole:].copy()], len(rows) - whole

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = encode_block(ids)
        wide = bool(len(escapes)) and int(escapes.max()) >> 32 > 0
        self.blocks.append((self.at, len(words), wide))
        data = words.astype("<u8").tobytes() + escapes.astype("<u8" if wide else "<u4").tobytes()
        self.file.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Writes what is left and the footer; returns the file's size."""
        if self.waiting:
            self._block(np.concatenate(self.pending))
        offset, words, wide = (list(c) for c in zip(*self.blocks, strict=True)) if self.blocks else ([], [], [])
        counts = np.concatenate(self.counts) if self.counts else np.empty(0, np.int64)
        docs = pa.concat_arrays([a.cast(self.kind) for a in self.doc_ids]) if self.doc_ids else pa.array([], self.kind)
        sink = io.BytesIO()
        for table in (pa.table({"doc_id": docs, "n": counts}), pa.table({"offset": pa.array(offset, pa.int64()), "words": pa.array(words, pa.int64()), "wide": pa.array(wide, pa.bool_())})):
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table)
        footer = sink.getvalue()
        tail = footer + struct.pack(TAIL, len(footer), self.total, MAGIC)
        self.file.write(tail)
        self.file.close()
        return self.at + len(tail)


class Reader:
    """Random access to a file's ids; the footer is read once, blocks by range."""

    def __init__(self, file):
        self.file, size, tail = file, file.size(), struct.calcsize(TAIL)
        footer, self.total, magic = struct.unpack(TAIL, file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.end = size - tail - footer
        source = io.BytesIO(file.read_at(footer, self.end))
        self.docs, self.blocks = pa.ipc.open_stream(source).read_all(), pa.ipc.open_stream(source).read_all()
        self.offsets, self.words, self.wide = (self.blocks[c].to_numpy() for c in ("offset", "words", "wide"))

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count; only the blocks that hold them are read."""
        count = min(count, self.total - start)
        if count <= 0:
            return np.empty(0, np.uint64)
        first, last = start // BLOCK_IDS, (start + count - 1) // BLOCK_IDS
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        data, parts = self.file.read_at(end - begin, begin), []
        for k in range(first, last + 1):
            at = int(self.offsets[k]) - begin
            stop = int(self.offsets[k + 1]) - begin if k < last else len(data)
            middle = at + 8 * int(self.words[k])
            words, escapes = np.frombuffer(data[at:middle], "<u8"), np.frombuffer(data[middle:stop], "<u8" if self.wide[k] else "<u4")
            parts.append(decode_block(words, escapes, min(BLOCK_IDS, self.total - k * BLOCK_IDS)))
        return np.concatenate(parts)[start - first * BLOCK_IDS :][:count]


# Classes of bytes: letter, digit, mark, apostrophe, space, other ASCII white space, the rest by whether it may end a white space.
_CLASS = np.full(256, 6, np.uint8)
for _b in range(0x80):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.isalpha() else 1 if _c.isdigit() else 3 if _c == "'" else 4 if _c == " " else 5 if _c in "\t\n\v\f\r" else 2 if _c.isprintable() else 7
_CLASS[[0x85, 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = 7
#: By class of a byte (times 8) and of the next: whether a pre-token must end between them. After white space none does surely.
_CUT = np.zeros(64, bool)
for _a, _after in ((0, (1, 2, 3, 4, 5)), (1, (0, 2, 3, 4, 5)), (2, (0, 1, 4, 5)), (3, (1, 4, 5)), (6, (4, 5))):
    _CUT[[8 * _a + b for b in _after]] = True
#: Pieces that are one pre-token for certain: letters of ASCII and Latin, digits, or marks, after a space or none.
_PLAIN = re.compile(r"\x20?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
#: How the vocabulary writes bytes: printable ones of Latin-1 as they are, the others as U+0100, U+0101, ... in their order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_WRITTEN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Ids of texts by the tokenizers library; each distinct piece of them is encoded once while it is remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}  # packed ids of the pieces that were asked for of late,
        self.older: dict[str, bytes] = {}  # and of those before

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older, model, hard = self.known, self.older, self.model, []
        for piece in pieces:
            if piece not in known:
                if (ids := older.get(piece)) is not None:
                    known[piece] = ids
                elif _PLAIN(piece):
                    written = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(_WRITTEN)
                    known[piece] = array("I", [t.id for t in model.tokenize(written)]).tobytes()
                else:
                    hard.append(piece)
        for some in itertools.batched(hard, 4096):
            found = self.whole.encode_batch_fast(list(some), add_special_tokens=False)
            known.update((piece, array("I", e.ids).tobytes()) for piece, e in zip(some, found, strict=True))
        return list(map(known.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        at, raw = bytes_of(texts)
        if not len(raw):
            return np.zeros(len(texts), np.int64), np.empty(0, np.uint32)
        kind = _CLASS[raw]
        cut = np.empty(len(raw), bool)
        cut[0] = True
        cut[1:] = _CUT[8 * kind[:-1] + kind[1:]]
        # a single white space other than a blank stands alone before what is surely none
        cut[2:] |= (kind[1:-1] == 5) & (kind[2:] <= 3) & (kind[:-2] != 4) & (kind[:-2] != 5) & (kind[:-2] != 7)
        cut[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        coded = strings(raw, starts).dictionary_encode()
        found = self._pieces(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        ends = np.cumsum(n)
        first = np.cumsum(lengths) - lengths
        ids = flat[np.repeat(first[codes] - ends + n, n) + np.arange(int(ends[-1]))]
        bounds = np.append(0, ends)[np.searchsorted(starts, at)]
        return np.diff(bounds), ids


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a worker process, so that it goes on with the pieces it knows."""
    return Encoder(vocabulary)


def write(docs: DataFrame, path: str | None = None, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes the ids of all documents, each with the end id after it, in ascending doc_id order; returns the manifest, a row for each file.

    part and seq give the order of the files. path: the vocabulary. folder: where to write, a new one under the shared folder if none.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, seq, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def close() -> pa.RecordBatch:
            size = writer.close()
            row = (part, seq, name, sum(map(len, writer.counts)), writer.total, size)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "seq", "file", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for own in slices(batch):
                if writer is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{folder}/ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.s8b"
                    writer = Writer(system.open_output_stream(f"{root}/{name.rpartition('/')[2]}"), own.column("doc_id").type)
                counts, ids = encoder(vocabulary.value).encode(own.column("text"))
                writer.add(own.column("doc_id"), counts + 1, np.insert(ids, np.cumsum(counts), end))
                if writer.at >= FILE_BYTES:
                    yield close()
                    seq, writer = seq + 1, None
        if writer is not None:
            yield close()

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    # the text decides between equal ids, so that many of them (null, say) don't make one range
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids in all files before: sums of the parts first, then within a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that wrote
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return files.join(parts, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def digests(manifest: DataFrame, kind: str) -> DataFrame:
    """Per document, from the files alone: doc_id (of that type), start (ids before it), n_tokens, and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    reader = Reader(file)
                    sizes = reader.docs["n"].to_numpy()
                    ends = np.cumsum(sizes)
                    crcs, doc, crc = np.zeros(len(sizes), np.int64), 0, 0
                    for at in range(0, reader.total, STEP * BLOCK_IDS):
                        data = memoryview(reader.read(at, STEP * BLOCK_IDS).astype("<u4").tobytes())
                        done, held = 0, len(data) // 4
                        while done < held:
                            stop = min(int(ends[doc]) - at, held)
                            crc = zlib.crc32(data[4 * done : 4 * stop], crc)
                            done = stop
                            if at + done == ends[doc]:
                                crcs[doc], doc, crc = crc, doc + 1, 0
                    ids = reader.docs["doc_id"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(base + ends - sizes), pa.array(sizes), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = stored(starts(manifest), "starts")
    n = max(1, min(files.count(), 1 << 16))
    dealt = files.select("file", "start").repartitionByRange(n, "start")  # a file a task, as far as there are so few
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read(manifest: DataFrame, kind: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the files; doc_id is of that type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    reader = Reader(file)
                    sizes = reader.docs["n"].to_numpy()
                    begins, ids = np.cumsum(sizes) - sizes, reader.docs["doc_id"].combine_chunks()
                    first = 0
                    while first < len(sizes):  # documents of some blocks, one at least
                        last = max(first + 1, int(np.searchsorted(begins + sizes, begins[first] + STEP * BLOCK_IDS, "right")))
                        own = sizes[first:last]
                        values = pa.array(reader.read(int(begins[first]), int(own.sum())).astype(np.int64))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)), pa.int32()), values)
                        yield pa.RecordBatch.from_arrays([ids[first:last], pa.array(base + begins[first:last]), lists], ["doc_id", "start", "ids"])
                        first = last

    return starts(manifest).select("file", "start").repartition("file").mapInArrow(run, f"doc_id {kind}, start long, ids array<long>")

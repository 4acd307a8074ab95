"""Media columns: content-addressed images in tar shards, described by header-only range reads.

A text becomes a payload: its UTF-8 bytes, padded with spaces to a positive
multiple of 192. The payload is stored losslessly as an 8-bit grey PNG, 192
samples wide. Payloads are addressed by their SHA-256: each distinct one is stored
once, in a tar shard under the shared folder, and rows carry its digest, shard,
offset and length. Width, height and sample depth come from the first bytes of
each member, read by range; features come from reading whole members back.

Payloads are never shuffled, only their digests. The owner of a payload that
several partitions hold is the least of these; the digests that a partition holds
but doesn't own are written to the shared folder, where its task finds them and
passes over their texts. Should rows stand in other partitions when they are read
again, payloads may be stored twice (then one pointer of them counts), and what no
task has written is found by its missing pointer and written in a second pass. A
shard only counts once the pointer table, written after it, names it; a repeated
task writes another shard under a name of its own. The shared folder may be any
store that pyarrow's file systems reach by URI.

Defined results: null or empty text is the payload of 192 spaces; a very long text
is one payload, held in memory by one task; equal texts have equal values; repeated
rows give a result each; a doc_id of any type, null too, stays as it is; an empty
table gives an empty result. Other columns of the input, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import new_folder, slices, stored, text_of

WIDTH, BLOCK = 192, 512
#: Bytes after which a shard is closed, and how hard samples are compressed.
SHARD_BYTES, LEVEL = 64 << 20, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, then length, type and fields of the first chunk: all that the metadata columns need.
HEADER = ">8sI4sIIBBBBB"
POINTER = "digest string, shard string, offset long, length long"
#: Folders that the lists of passed-over digests are dealt into by partition.
LISTS = 4096


def payload(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of WIDTH."""
    return text + b" " * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def encode_png(samples: bytes) -> bytes:
    """An 8-bit grey image, WIDTH wide, every row without a filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, LEVEL)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The samples of an image that encode_png made, a row each."""
    at, data, width = len(SIGNATURE), b"", 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)[:, 1:]


def digest(text: Column) -> Column:
    """The payload's SHA-256, from the text; no Python needed."""
    size = F.octet_length(text)
    padding = F.greatest(F.lit(1), F.ceil(size / F.lit(WIDTH)).cast("int")) * WIDTH - size
    return F.sha2(F.concat(text, F.repeat(F.lit(" "), padding)), 256)


def _passed_over(held: DataFrame) -> str:
    """Writes, for every partition, the digests it holds that a lesser partition owns, from rows (d, p); returns the folder."""
    folder = new_folder(held.sparkSession, "owned")
    owned = held.groupBy("d").agg(F.min("p").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    rest = held.join(owned, "d").where("p != owner").select("p", "d", (F.col("p") % LISTS).alias("list"))
    rest.repartition("list").write.partitionBy("list").parquet(folder)
    return folder


def _listed(folder: str, partition: int) -> set[str]:
    """The digests that a partition passes over."""
    system, root = fs.FileSystem.from_uri(f"{folder}/list={partition % LISTS}")
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return set()
    found: set[str] = set()
    for file in system.get_file_info(fs.FileSelector(root)):
        if file.base_name.endswith(".parquet"):
            with system.open_input_file(file.path) as f:
                rows = pq.read_table(f, columns=["p", "d"])
            found.update(x.hex() for x in rows.filter(pc.equal(rows["p"], partition))["d"].to_pylist())
    return found


def _write(texts: DataFrame, folder: str, passed_over: str | None) -> DataFrame:
    """Writes the payloads of texts (digest, text) into tar shards, each task each digest once, without those that it passes over."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        seen = _listed(passed_over, TaskContext.get().partitionId()) if passed_over else set()
        shard, name, at, rows = None, "", 0, []

        def close() -> pa.RecordBatch:
            shard.write(bytes(2 * BLOCK))
            shard.close()
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["digest", "shard", "offset", "length"])

        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column("digest").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    if shard is None:
                        name, at, rows = f"shard-{uuid.uuid4().hex}.tar", 0, []
                        shard = system.open_output_stream(f"{root}/{name}")
                    image = encode_png(payload(text))
                    member = tarfile.TarInfo(f"{key}.png")
                    member.size = len(image)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    padding = bytes(-len(image) % BLOCK)
                    shard.write(head + image + padding)
                    rows.append((key, f"{folder}/{name}", at + len(head), len(image)))
                    at += len(head) + len(image) + len(padding)
                    if at >= SHARD_BYTES:
                        yield close()
                        shard = None
        if shard is not None:
            yield close()

    return texts.mapInArrow(write, POINTER)


def store(docs: DataFrame) -> DataFrame:
    """Writes the distinct payloads of docs into tar shards; returns the pointer table: digest, shard, offset, length."""
    text = text_of(docs)
    texts = docs.select(digest(text).alias("digest"), text.alias("text"))
    folder = new_folder(docs.sparkSession, "media")
    held = stored(texts.select(F.unhex("digest").alias("d"), F.spark_partition_id().alias("p")).distinct(), "held")
    written = stored(_write(texts, folder, _passed_over(held)), "written")
    missing = held.select("d").join(written.select(F.unhex("digest").alias("d")), "d", "left_anti").distinct()
    missing = stored(missing.select(F.lower(F.hex("d")).alias("digest")), "missing")
    if not missing.isEmpty():
        again = texts.join(missing, "digest").groupBy("digest").agg(F.first("text").alias("text"))
        written = written.union(stored(_write(again, folder, None), "written"))
    least = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    ordered = least.select("digest", "at.*").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return stored(ordered, "pointers")


def _by_shard(pointers: DataFrame, read: Callable, columns: dict[str, str]) -> DataFrame:
    """read(file, offset, length) of every pointer as further columns; each shard is opened once for a run of its rows."""
    kinds = [_ARROW[k] for k in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    system, path = fs.FileSystem.from_uri(shard)
                    name, file = shard, system.open_input_file(path)
                rows.append(read(file, offset, length))
            found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *columns])

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in pointers.schema]
    return pointers.mapInArrow(run, ", ".join([*schema, *(f"{n} {k}" for n, k in columns.items())]))


HEADER_COLUMNS = {"format": "string", "width": "int", "height": "int", "depth": "int"}
FEATURE_COLUMNS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def describe(pointers: DataFrame) -> DataFrame:
    """Pointers with format, width, height and sample depth; only the first bytes of each member are read, by range."""

    def read(file, offset: int, length: int) -> tuple:
        signature, _, _, width, height, depth, *_ = struct.unpack(HEADER, file.read_at(struct.calcsize(HEADER), offset))
        return ("png" if signature == SIGNATURE else "unknown", width, height, depth)

    return _by_shard(pointers, read, HEADER_COLUMNS)


def features(pointers: DataFrame) -> DataFrame:
    """Pointers with what reading each member back gives: digests, sizes, the tail's CRC-32, a feature.

    The feature is the mean of the samples in each of eight equal bands of rows (the last takes the rest), with three decimals.
    """

    def read(file, offset: int, length: int) -> tuple:
        image = file.read_at(length, offset)
        samples = decode_png(image)
        raw = samples.tobytes()
        step = max(1, len(samples) // 8)
        bands = [samples[i * step : (i + 1) * step if i < 7 else None] for i in range(8)]
        shown = ",".join(f"{b.sum(dtype=np.int64) / b.size:.3f}" for b in bands if b.size)
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(image), hashlib.sha256(image).hexdigest(), shown

    return _by_shard(pointers, read, FEATURE_COLUMNS)


def members(archive: bytes) -> list[str]:
    """The names in a tar shard, for checks."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
        return tar.getnames()


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, where its payload is stored, the header's columns, and the features of the payload read back."""
    found = stored(features(describe(store(docs))).withColumn("key", F.unhex("digest")), "features")
    text = text_of(docs)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(digest(text)).alias("key"))
    return rows.join(found, "key").drop("key")

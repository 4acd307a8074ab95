"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

Pre-tokens are exploded with their positions a block of documents at a time: a
block holds its distinct words once and, for every position, a word's number.
Only the distinct words are shuffled; each meets all its blocks in one bucket, is
encoded there once, and its ids go back to the blocks, where the positions put
the documents together again. Blocks are written once as a table bucketed by
block, so the positions never move. Decoding looks every id up in the token-byte
table, whose size the vocabulary fixes.

Memory is bounded: a block ends after BLOCK_WORDS pre-tokens (or with the
document that crosses it), and a bucket keeps its own distinct words; there are as
many buckets as shuffle partitions, BUCKETS at least, so a bucket doesn't grow
where partitions are set to the input's size.

What the stored rows hold, all packed (numbers as zstd-compressed byte planes):

    block  bucket  start  count  sizes, words      ids, counts, codes
    17     -1      0      0      -                 doc_ids of the block, pre-tokens of each, the number of the word at each position
    17     4       0      310    the words 0..309  -
    17     9       310    285    310..594          -

Defined results: null or empty text gives no ids and decodes to no bytes; a very
long text is a block of its own; repeated rows give a result each; a doc_id of any
type, null too, stays as it is; an empty table gives an empty result. Other columns
of the input, whatever their names, are ignored. No table stays in the catalog.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import new_folder, slices, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens after which a block ends, and buckets at least that distinct words are dealt into.
BLOCK_WORDS, BUCKETS = 2_000_000, 1024
#: Pre-tokens that are put together in one numpy step.
STEP = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _pack(column: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(column.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, count: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, 4 * count, asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed_words(words: list[bytes], starts: list[int], ends: list[int]) -> dict[str, list]:
    """The columns count, sizes and words of a block's rows: none for the block itself, then the words from each start to its end."""
    zstd = pa.Codec("zstd", 3)
    own = [words[a:b] for a, b in zip(starts, ends, strict=True)]
    sizes = [_pack(np.fromiter(map(len, w), np.int64, len(w))) for w in own]
    return {"count": [0, *map(len, own)], "sizes": [None, *sizes], "words": [None, *(zstd.compress(b"".join(w), asbytes=True) for w in own)]}


def _unpacked_words(row: dict) -> list[bytes]:
    ends = np.cumsum(_unpack(row["sizes"], row["count"])).tolist()
    joined = pa.Codec("zstd").decompress(row["words"], ends[-1], asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per block with its documents and positions, and a row per block and bucket with the bucket's distinct words."""
    plain = [("block", pa.int64()), ("bucket", pa.int32()), ("start", pa.int32()), ("count", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, base, done = regex.compile(public_tokenizers.PATTERN).findall, TaskContext.get().partitionId() << 32, 0

        def block(number: int, kind: pa.DataType, ids: list, counts: list[int], codes: list[np.ndarray], words: dict[str, int]) -> pa.RecordBatch:
            raw = [w.encode() for w in words]
            home = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(home, kind="stable")
            new = np.empty(len(raw), np.int64)
            new[order] = np.arange(len(raw))
            all_codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
            kinds, starts = np.unique(home[order], return_index=True)
            n = len(kinds)
            ends = [*starts.tolist()[1:], len(raw)][:n]
            rows = {
                "block": [number] * (n + 1),
                "bucket": [-1, *kinds.tolist()],
                "start": [0, *starts.tolist()],
                **_packed_words([raw[i] for i in order.tolist()], starts.tolist(), ends),
                "ids": [ids] + [None] * n,
                "counts": [counts] + [None] * n,
                "codes": [_pack(new[all_codes])] + [None] * n,
            }
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([*plain, ("ids", pa.list_(kind)), ("counts", pa.list_(pa.int32())), ("codes", pa.binary())]))

        kind = pa.null()
        ids: list = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        words: dict[str, int] = defaultdict()
        words.default_factory = words.__len__
        seen = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = find(text)
                    codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    ids.append(doc_id)
                    counts.append(len(found))
                    seen += len(found)
                    if seen >= BLOCK_WORDS:
                        yield block(base + done, kind, ids, counts, codes, words)
                        ids, counts, codes, seen, done = [], [], [], 0, done + 1
                        words.clear()
        if ids:
            yield block(base + done, kind, ids, counts, codes, words)

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, bucket int, start int, count int, sizes binary, words binary, ids array<{kind}>, counts array<int>, codes binary")


def _encoded(words: DataFrame, ranks) -> DataFrame:
    """For each row of words: how many ids every word has, and the ids. A bucket's words come together, so each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tiktoken.Encoding("plinth", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            out: dict[str, list] = {"block": [], "start": [], "lengths": [], "tokens": []}
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                found = []
                for w in _unpacked_words(row):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = np.array(own.encode_ordinary(w.decode()), "<u4").tobytes()
                    found.append(ids)
                out["block"].append(row["block"])
                out["start"].append(row["start"])
                out["lengths"].append(_pack(np.fromiter((len(x) // 4 for x in found), np.int64, len(found))))
                out["tokens"].append(_pack(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_pydict(
                out | {"count": batch.column("count")},
                schema=pa.schema([("block", pa.int64()), ("start", pa.int32()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("count", pa.int32())]),
            )

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, start int, lengths binary, tokens binary, count int")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs: the whole text's tokens, without special tokens."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))
    folder = new_folder(spark, "blocks")
    name = "blocks_" + folder.rpartition("-")[2]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = _blocks(docs, max(BUCKETS, parts)).write.option("path", folder).option("compression", "zstd")
    writer.bucketBy(parts, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table: its files, and what was read of it, stay
    words = table.where("bucket >= 0").select("block", "bucket", "start", "count", "sizes", "words")
    homes = table.where("bucket < 0").select("block", "ids", "counts", "codes")
    kind = table.schema["ids"].dataType.elementType.simpleString()

    def assemble(home: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("start")
        sizes = found.column("count").to_pylist()
        lengths = [_unpack(x.as_py(), n) for x, n in zip(found.column("lengths"), sizes, strict=True)]
        tokens = [_unpack(x.as_py(), int(n.sum())) for x, n in zip(found.column("tokens"), lengths, strict=True)]
        length = np.concatenate([*lengths, np.empty(0, "<u4")]).astype(np.int64)
        flat = np.concatenate([*tokens, np.empty(0, "<u4")]).astype(np.int32)
        first = np.cumsum(length) - length
        counts = np.asarray(home.column("counts")[0].as_py(), np.int64)
        codes = _unpack(home.column("codes")[0].as_py(), int(counts.sum()))
        parts = []
        for at in range(0, len(codes), STEP):
            c = codes[at : at + STEP]
            n = length[c]
            ends = np.cumsum(n)
            parts.append(flat[np.repeat(first[c] - ends + n, n) + np.arange(int(n.sum()))])
        ends = np.concatenate(([0], np.cumsum(length[codes])))[np.concatenate(([0], np.cumsum(counts)))]
        values = pa.array(np.concatenate([*parts, np.empty(0, np.int32)]), pa.int32())
        return pa.table({"doc_id": home.column("ids").combine_chunks().flatten(), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})

    both = homes.groupBy("block").cogroup(_encoded(words, ranks).groupBy("block"))
    return both.applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def _token_table(spark: SparkSession, path: str | None):
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    return spark.sparkContext.broadcast([b for b, _ in sorted(ranks.items(), key=lambda x: x[1])])


def _joined(ids: pa.ListArray, table: pa.Array, between: bytes) -> pa.Array:
    """Each row's table entries, one after another."""
    taken = pc.take(table, ids.flatten())
    sizes = np.asarray(pc.list_value_length(ids), np.int64)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, taken), pa.scalar(between, pa.large_binary()))


def _lists(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many ids."""
    start, seen = 0, 0
    for i, n in enumerate(pc.list_value_length(batch.column("ids")).to_pylist()):
        if seen and seen + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, seen = i, 0
        seen += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, data) for rows (doc_id, ids): the bytes that the ids stand for. A null list counts as empty."""
    table = _token_table(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(table.value, pa.large_binary())
        for batch in batches:
            for part in _lists(batch):
                data = _joined(part.column("ids"), own, b"").cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), data], ["doc_id", "data"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids and of the bytes that the ids decode to."""
    table = _token_table(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(table.value, pa.large_binary())
        decimal = pa.array([b"%d" % i for i in range(len(table.value))], pa.large_binary())

        def sha(column: pa.Array) -> pa.Array:
            return pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in column], pa.string())

        for batch in batches:
            for part in _lists(batch):
                ids = part.column("ids")
                n = pc.list_value_length(ids).cast(pa.int64())
                columns = [part.column("doc_id"), n, sha(_joined(ids, decimal, b" ")), sha(_joined(ids, own, b""))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""A data source that writes generations of rows and commits them by messages.

    spark.dataSource.register(GenerationSource)
    rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        .write.format("generation").option("path", folder).option("key", "chunk_id").mode("append").save()

Each task writes one Parquet file under a name of its own and returns a message: the
file, its rows, bytes and SHA-256, its least and greatest key, and whether a key
occurred twice. The commit, on the driver, sees messages only, never rows: it refuses
a generation with repeated keys, with files whose ranges of keys overlap (then the
rows weren't dealt by ranges, and repeats across files couldn't be seen) or, where
the option ``rows`` is given, of another number of rows. What passes gets a manifest
that lists the files, and is then named by the pointer, one small file that is
replaced as a whole. Where a task or a check fails, the written files are deleted
and the pointer stays as it was. Readers follow pointer and manifest, so files that
no manifest names are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER, MANIFEST = "CURRENT", "manifest.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    size: int
    sha256: str
    least: object
    greatest: object
    repeated: bool


class _Hashing:
    """A stream that passes bytes on and keeps their number and digest."""

    def __init__(self, stream):
        self.stream, self.size, self.digest, self.closed = stream, 0, hashlib.sha256(), False

    def write(self, data) -> int:
        self.size += len(data)
        self.digest.update(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def tell(self) -> int:
        return self.size

    def close(self) -> None:
        self.closed = True
        self.stream.close()


class GenerationWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        for name in ("path", "key"):
            if name not in options:
                raise ValueError(f"the option {name} is missing")
        self.path, self.key, self.schema = options["path"], options["key"], schema.json()
        self.expected = int(options["rows"]) if "rows" in options else None
        self.generation = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        system, root = _opened(self.path)
        name, out, writer = f"{self.generation}/{uuid.uuid4().hex}.parquet", None, None
        rows, least, greatest, repeated = 0, None, None, False
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(self.key))
            if keys.null_count:
                raise ValueError("a key is null")
            before, first = greatest, keys[0].as_py()
            if before is not None and first < before or pc.any(pc.less(keys[1:], keys[:-1])).as_py():
                raise ValueError("rows must come sorted by key")
            repeated |= first == before or bool(pc.any(pc.equal(keys[1:], keys[:-1])).as_py())
            if writer is None:
                system.create_dir(f"{root}/{self.generation}", recursive=True)
                out = _Hashing(system.open_output_stream(f"{root}/{name}"))
                writer, least = pq.ParquetWriter(pa.PythonFile(out, "w"), batch.schema, compression="zstd"), first
            writer.write_batch(batch)
            rows, greatest = rows + batch.num_rows, keys[-1].as_py()
        if writer is None:
            return Written("", 0, 0, "", None, None, False)
        writer.close()
        out.close()
        return Written(name, rows, out.size, out.digest.hexdigest(), least, greatest, repeated)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((m for m in messages if m is not None and m.rows), key=lambda m: (m.least, m.greatest))
        total = sum(m.rows for m in files)
        wrong = None
        if any(m.repeated for m in files) or any(b.least == a.greatest for a, b in zip(files, files[1:], strict=False)):
            wrong = "a key occurs twice"
        elif any(b.least < a.greatest for a, b in zip(files, files[1:], strict=False)):
            wrong = "ranges of keys overlap: repartitionByRange by the key"
        elif self.expected is not None and self.expected != total:
            wrong = f"{total} rows were written, not {self.expected}"
        if wrong:
            self.abort(messages)
            raise ValueError(wrong)
        system, root = _opened(self.path)
        system.create_dir(f"{root}/{self.generation}", recursive=True)
        listed = [{"file": m.file, "rows": m.rows, "bytes": m.size, "sha256": m.sha256} for m in files]
        with system.open_output_stream(f"{root}/{self.generation}/{MANIFEST}") as out:
            out.write(json.dumps({"generation": self.generation, "rows": total, "schema": self.schema, "files": listed}).encode())
        with system.open_output_stream(f"{root}/{POINTER}.{self.generation}") as out:
            out.write(self.generation.encode())
        system.move(f"{root}/{POINTER}.{self.generation}", f"{root}/{POINTER}")

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the generation's folder; tasks that failed leave no message, but their files stand there, too."""
        system, root = _opened(self.path)
        if system.get_file_info(f"{root}/{self.generation}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.generation}")


class GenerationSource(DataSource):
    """The data source ``generation``; written as above, read with ``read``."""

    @classmethod
    def name(cls) -> str:
        return "generation"

    def writer(self, schema: StructType, overwrite: bool) -> GenerationWriter:
        return GenerationWriter(self.options, schema)


def current(folder: str) -> dict | None:
    """The manifest of the current generation, or None."""
    system, root = _opened(folder)
    if system.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{POINTER}") as file:
        name = file.read().decode()
    with system.open_input_stream(f"{root}/{name}/{MANIFEST}") as file:
        return json.loads(file.read())


def write(rows: DataFrame, folder: str, key: str, expected: int | None = None) -> dict:
    """Writes rows as a new generation and makes it the current one; returns its manifest."""
    rows.sparkSession.dataSource.register(GenerationSource)
    out = rows.repartitionByRange(key).sortWithinPartitions(key).write.format("generation").option("path", folder).option("key", key)
    (out if expected is None else out.option("rows", expected)).mode("append").save()
    return current(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the current generation, from the files that its manifest names; an empty one has its columns and no rows."""
    found = current(folder)
    if found is None:
        raise ValueError("the folder has no generation")
    if not found["files"]:
        if "schema" not in found:
            raise ValueError("the generation is empty")
        return spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])))
    return spark.read.parquet(*(f"{folder.rstrip('/')}/{f['file']}" for f in found["files"]))


def forget(folder: str) -> None:
    """Takes the pointer away: the folder has no generation then; its files stay, unread."""
    system, root = _opened(folder)
    if system.get_file_info(f"{root}/{POINTER}").type != fs.FileType.NotFound:
        system.delete_file(f"{root}/{POINTER}")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """(file, found) of the files whose bytes aren't those that were written; each file is digested by a task, a piece at a time."""
    rows = [(f["file"], f["sha256"], f["bytes"]) for f in (current(folder) or {"files": []})["files"]]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("file").to_pylist():
                system, root = _opened(folder)
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    found.append("missing")
                    continue
                own = hashlib.sha256()
                with system.open_input_stream(f"{root}/{name}") as file:
                    while piece := file.read(1 << 20):
                        own.update(piece)
                found.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("sha256"), pa.array(found, pa.string())], ["file", "sha256", "found"])

    listed = spark.createDataFrame(rows, "file string, sha256 string, bytes long").select("file", "sha256").repartition("file")
    return listed.mapInArrow(digest, "file string, sha256 string, found string").where("found <> sha256").select("file", "found")

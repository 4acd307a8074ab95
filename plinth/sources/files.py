"""Files as tables: folders of text, JSON lines, evaluation cases and traces. All reading is Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plinth.sources.shared import stored

EXTENSIONS = ("md", "txt", "pdf")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, extension, supported, length and content of every file below a folder, or of a single file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    relative = F.when(F.startswith(plain, F.lit(root)), F.substring(plain, len(root) + 1, 1 << 20)).otherwise(F.regexp_extract(plain, "[^/]*$", 0))
    rows = files.withColumn("relative_path", relative)
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("relative_path", r"\.([^./]*)$", 1)))
    return rows.select("relative_path", "extension", F.col("extension").isin(*EXTENSIONS).alias("supported"), "length", "content")


def report(files: DataFrame) -> DataFrame:
    """media_type (null for what is skipped), supported, and number and characters of files (path, n_chars), by their extension in any case."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    media = F.when(extension == "md", "text/markdown").when(extension == "txt", "text/plain").when(extension == "pdf", "application/pdf")
    rows = files.withColumn("media_type", media)
    return rows.groupBy("media_type", F.col("media_type").isNotNull().alias("supported")).agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


def in_order(files: DataFrame) -> DataFrame:
    """Files by depth, then by path in any case."""
    return files.orderBy(F.size(F.split("relative_path", "/")), F.lower("relative_path"))


def text_documents(files: DataFrame) -> DataFrame:
    """document_id, source_path, media_type and text of Markdown and text files, with line feeds as their only line ends."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    media = F.when(F.col("extension") == "md", "text/markdown").otherwise("text/plain")
    rows = files.where(F.col("extension").isin("md", "txt"))
    return rows.select(F.col("relative_path").alias("document_id"), F.col("relative_path").alias("source_path"), media.alias("media_type"), text.alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``_corrupt_record``, null where a line is sound; empty lines are passed over."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def sound(rows: DataFrame) -> DataFrame:
    """Rows of json_lines; a corrupt one is an error when it is read."""
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("_corrupt_record", 1, 200))).cast("boolean")
    return rows.where(F.when(F.col("_corrupt_record").isNotNull(), bad).otherwise(F.lit(True))).drop("_corrupt_record")


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON object, over any number of lines; another content is an error when it is read."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return sound(rows)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_number from 1, and value of every line of text files; the lines of a file are numbered in one task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    order = Window.partitionBy("file").orderBy("block", "id")
    return rows.select("file", F.row_number().over(order).alias("line_number"), "value")


def require(rows: DataFrame, ok: Column, message: Column) -> DataFrame:
    """rows, of which one where ``ok`` isn't true is an error when it is read."""
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


CASES = "id string, query string, expected_chunk_ids array<string>, expected_source_paths array<string>, notes string, metadata map<string,string>"


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, with ``line_number``; what else a case holds goes to its metadata.

    Empty lines are passed over. A line that is no object, and a case without a query or without any expectation, are errors that name
    the line, when it is read; a file without cases is an error at once.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError("no evaluation cases found")
    known = [part.split()[0] for part in CASES.split(", ")]
    rows = lines.withColumns({"c": F.from_json("value", CASES), "all": F.from_json("value", "map<string,string>")})
    where = F.concat(F.lit("line "), F.col("line_number").cast("string"))
    rows = require(rows, F.col("value").rlike(r"^\s*\{") & F.col("all").isNotNull(), F.concat(where, F.lit(": not a JSON object")))
    own = F.coalesce("c.metadata", F.create_map().cast("map<string,string>"))
    rest = F.map_filter("all", lambda k, _: ~k.isin(*known) & ~F.map_contains_key(own, k))
    rows = rows.select("line_number", *(f"c.{k}" for k in known if k != "metadata"), F.map_concat(own, rest).alias("metadata"))
    some = (F.size(F.coalesce("expected_chunk_ids", F.array())) > 0) | (F.size(F.coalesce("expected_source_paths", F.array())) > 0)
    return require(rows, (F.trim("query") != "") & some, F.concat(where, F.lit(": incomplete case "), F.coalesce("id", F.lit("?"))))


def write_cases(cases: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cases as JSON lines; what is there stays unless ``overwrite`` says otherwise."""
    cases.write.mode("overwrite" if overwrite else "errorifexists").json(path)


COMPACT = ("query_id", "rank", "matched_by", "reciprocal_rank", "recall", "n_retrieved")


def compact_cases(rows: DataFrame) -> DataFrame:
    """The rows of an evaluation with their main columns, ``passed``, and everything else as JSON in ``metadata``."""
    others = [c for c in rows.columns if c not in COMPACT]
    return rows.select(*COMPACT, F.col("rank").isNotNull().alias("passed"), F.to_json(F.struct(*others)).alias("metadata"))


def run_summary(metrics: DataFrame, failures: DataFrame) -> DataFrame:
    """(position, value): a run's metrics (one row) by name, then its failures (failure, n), as lines of Markdown."""
    names = sorted(metrics.columns)
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n).cast("string"), F.lit("-")).alias("value")) for n in names))
    top = metrics.select(F.explode(pairs).alias("p")).select(F.lit(1).alias("part"), "p.name", F.concat(F.lit("| "), "p.name", F.lit(" | "), "p.value", F.lit(" |")).alias("value"))
    low = failures.select(F.lit(3).alias("part"), F.col("failure").alias("name"), F.concat(F.lit("| "), "failure", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("value"))
    heads = metrics.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit("").alias("name"), F.lit(v).alias("value")) for k, v in ((0, "# Retrieval run\n\n| metric | value |\n|-|-|"), (2, "\n| failure | cases |\n|-|-|"))))).alias("h")).select("h.*")
    rows = heads.unionByName(top).unionByName(low)
    return rows.select(F.row_number().over(Window.orderBy("part", "name")).alias("position"), "value")  # a line for each metric and kind of failure


def write_run(folder: str, name: str, metrics: DataFrame, cases: DataFrame, failures: DataFrame) -> str:
    """Writes a run's summary (JSON and Markdown), cases, and failed cases below folder/name, or name-001 and on where that is taken."""
    for n in range(1000):
        path = f"{folder}/{name}" + (f"-{n:03d}" if n else "")
        try:
            metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/summary.json")
        except AnalysisException:
            continue
        compact = compact_cases(cases)
        compact.write.json(f"{path}/cases.jsonl")
        compact.where("not passed").write.json(f"{path}/failures.jsonl")
        run_summary(metrics, failures).orderBy("position").select("value").coalesce(1).write.text(f"{path}/summary.md")
        return path
    raise ValueError(f"too many runs named {name}")


TRACE = "trace_id string, operation string, status string, started_at string, finished_at string, details map<string,string>"


def traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound traces, and a warning for each line that is none."""
    rows = json_lines(spark, path, TRACE)
    good = F.col("_corrupt_record").isNull() & F.col("trace_id").isNotNull()
    warning = F.concat(F.lit("not a trace: "), F.coalesce(F.substring("_corrupt_record", 1, 80), F.lit("no trace_id")))
    return rows.where(good).drop("_corrupt_record"), rows.where(~good).select(warning.alias("warning"))


def write_traces(rows: DataFrame, path: str) -> None:
    """Adds traces to a folder of JSON lines."""
    rows.select(*(part.split()[0] for part in TRACE.split(", "))).write.mode("append").json(path)


def find_trace(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """The trace of an id; an id that isn't plain letters, digits, dashes and underscores is refused."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", trace_id):
        raise ValueError("not a trace id")
    return traces(spark, path)[0].where(F.col("trace_id") == trace_id)


# What chunks may say about where they come from.
MEDIA_TYPES = ("text/markdown", "text/plain", "application/pdf")
STRATEGIES = ("simple", "block")


def normal_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of any columns as (chunk_id, document_id, source_path, text, chunk_index, start_char, end_char, media_type, strategy).

    Missing columns and values get defaults, numbers written as text are read; ``id`` serves for chunk_id, index for chunk_index. A chunk
    without an id or a text, and a media type or strategy that isn't known, are errors when they are read.
    """

    def column(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(None).cast("string"))

    path = F.coalesce(column("source_path", "document_id"), F.lit("unknown"))
    out = rows.select(
        column("chunk_id", "id").alias("chunk_id"), F.coalesce(column("document_id"), path).alias("document_id"), path.alias("source_path"), column("text").alias("text"),
        F.coalesce(column("chunk_index", "index").try_cast("int"), F.lit(0)).alias("chunk_index"),
        column("start_char").try_cast("int").alias("start_char"), column("end_char").try_cast("int").alias("end_char"), column("media_type").alias("media_type"), F.coalesce(column("strategy"), F.lit("simple")).alias("strategy"),
    )
    out = require(out, F.col("chunk_id").isNotNull() & F.col("text").isNotNull(), F.concat(F.lit("a chunk lacks its id or text: "), F.coalesce("chunk_id", F.lit("?"))))
    known = (F.col("media_type").isNull() | F.col("media_type").isin(*MEDIA_TYPES)) & F.col("strategy").isin(*STRATEGIES)
    return require(out, known, F.concat(F.lit("unknown media type or strategy of "), "chunk_id"))


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents of a folder's Markdown and text files, and the files that are skipped (relative_path); none to read is an error."""
    files = scan(spark, folder)
    wanted = F.col("extension").isin("md", "txt")
    if files.where(wanted).isEmpty():
        raise ValueError(f"no supported file under {folder}")
    return text_documents(files), files.where(~wanted).select("relative_path")


def evidence_files(files: DataFrame) -> DataFrame:
    """Files that evidence may be taken from: supported, and not what the engine itself wrote below a folder ``.plinth``."""
    return files.where(F.col("supported") & ~F.col("relative_path").rlike(r"(^|/)\.plinth/"))


#: Folders that sessions are dealt into by a hash of their id, and parts of a folder.
SESSION_FOLDERS, SESSION_PARTS = 256, 8


def write_sessions(turns: DataFrame, folder: str) -> None:
    """Turns (session_id, turn, role, text, ...) as JSON lines in SESSION_FOLDERS folders by a hash of the session; a session that is there
    is replaced. Only the folders of the sessions given are read and written again."""
    spark = turns.sparkSession
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_FOLDERS)).cast("int")
    new = stored(turns.withColumn("bucket", bucket), "sessions")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # SESSION_FOLDERS at most
    try:
        old = spark.read.schema(new.schema).json(folder).where(F.col("bucket").isin(touched))
        kept = old.join(new.select("session_id").distinct(), "session_id", "left_anti").select(*new.columns)
        new = stored(kept.unionByName(new), "sessions")
    except AnalysisException:  # nothing is there yet
        pass
    dealt = new.repartition("bucket", F.pmod(F.xxhash64("session_id", "turn"), F.lit(SESSION_PARTS)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(folder)


def read_sessions(spark: SparkSession, folder: str, schema: str = "session_id long, turn int, role string, text string") -> DataFrame:
    """The turns of all sessions of a folder."""
    return spark.read.schema(f"{schema}, bucket int").json(folder).drop("bucket")


def latest_session(turns: DataFrame, updated: DataFrame) -> DataFrame:
    """The turns of the session (session_id, updated_at) that was changed last; of several, that of the greatest id."""
    last = updated.orderBy(F.desc("updated_at"), F.desc("session_id")).limit(1).select("session_id")
    return turns.join(F.broadcast(last), "session_id", "left_semi")

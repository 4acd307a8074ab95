"""Snapshots, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from plinth.operators.chunking import sliding_chunks
from plinth.sources import files, snapshots
from plinth.sources.tables import documents, table
from plinth.streaming.ingest import stream_chunks, stream_windows

CHUNK = "chunk_id string, text string"


def test_generations(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert snapshots.status(spark, folder) == "not_initialized"
    first = snapshots.commit(folder, spark.createDataFrame([("a", "x"), ("b", "y")], CHUNK))
    assert snapshots.status(spark, folder) == "ready" and snapshots.active(spark, folder)["snapshot_id"] == first
    with pytest.raises(ValueError, match="twice"):
        snapshots.commit(folder, spark.createDataFrame([("a", "x"), ("a", "y")], CHUNK))
    assert snapshots.active(spark, folder)["snapshot_id"] == first and snapshots.read(spark, folder).count() == 2
    vectors = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>")
    second = snapshots.child(spark, folder, vectors)
    row = snapshots.active(spark, folder)
    assert (row["snapshot_id"], row["parent_snapshot_id"], row["n_chunks"], row["n_vectors"]) == (second, first, 2, 1)
    assert snapshots.read(spark, folder, "vectors").count() == 1
    with pytest.raises(ValueError, match="no chunk"):
        snapshots.child(spark, folder, spark.createDataFrame([("z", [1.0])], vectors.schema))


def test_migration(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    legacy = spark.createDataFrame([("a", "x", None), ("b", "y", 1)], CHUNK + ", schema_version int")
    assert snapshots.migrate(folder, legacy, dry_run=True)["snapshot_id"] is None and snapshots.active(spark, folder) is None
    snapshots.migrate(folder, legacy)
    assert {r[0] for r in snapshots.read(spark, folder).select("schema_version").collect()} == {2}
    with pytest.raises(ValueError, match="unknown"):
        snapshots.migrate(folder, spark.createDataFrame([("a", "x", 3)], legacy.schema))


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("b.md", "# B\r\nline\rend"), ("A.txt", "a"), ("sub/c.md", "c"), ("skip.bin", "x")):
        (tmp_path / name).write_bytes(text.encode())
    found = files.scan(spark, f"file://{tmp_path}")
    assert [r["relative_path"] for r in files.in_order(found.where("supported")).collect()] == ["A.txt", "b.md", "sub/c.md"]
    texts = {r["document_id"]: r["text"] for r in files.text_documents(found).collect()}
    assert texts == {"b.md": "# B\nline\nend", "A.txt": "a", "sub/c.md": "c"}
    assert [r["relative_path"] for r in files.scan(spark, f"file://{tmp_path}/b.md").collect()] == ["b.md"]


def test_json_lines(spark, tmp_path):
    case = {"id": "1", "query": "q", "expected_source_paths": ["a.md"]}
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(case) + "\n\n")
    assert files.evaluation_cases(spark, f"file://{path}").collect()[0]["query"] == "q"
    path.write_text(json.dumps({"id": "2", "query": "q"}) + "\n")
    with pytest.raises(Exception, match="incomplete case 2"):
        files.evaluation_cases(spark, f"file://{path}").collect()
    path.write_text('{"trace_id": "t", "operation": "ask", "status": "ok", "started_at": "2024"}\nnot json\n{"operation": "ask"}\n')
    good, warnings = files.traces(spark, f"file://{path}")
    assert [r["trace_id"] for r in good.collect()] == ["t"] and warnings.count() == 2


def test_cases_with_more(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("\n" + json.dumps({"id": "1", "query": "q", "expected_chunk_ids": ["c"], "metadata": {"k": "own"}, "level": 3, "k": "other", "deep": {"a": [1]}}) + "\n")
    row = files.evaluation_cases(spark, f"file://{path}").first()
    assert row["line_number"] == 2 and row["metadata"] == {"k": "own", "level": "3", "deep": '{"a":[1]}'}
    path.write_text("[1]\n")
    with pytest.raises(Exception, match="line 1: not a JSON object"):
        files.evaluation_cases(spark, f"file://{path}").collect()
    path.write_text("\n")
    with pytest.raises(ValueError, match="no evaluation cases"):
        files.evaluation_cases(spark, f"file://{path}")
    rows = spark.createDataFrame([("1", "q")], "id string, query string")
    files.write_cases(rows, f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_cases(rows, f"file://{tmp_path}/out")
    files.write_cases(rows, f"file://{tmp_path}/out", overwrite=True)


def test_objects_and_lookups(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('{\n "a": 1\n}')
    assert files.json_object(spark, f"file://{path}", "a int").first()["a"] == 1
    path.write_text("no")
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_object(spark, f"file://{path}", "a int").collect()
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            files.find_trace(spark, f"file://{tmp_path}", bad)


def test_run_names_collide(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, None)], "recall double, mrr double")
    cases = spark.createDataFrame([(1, 1, "chunk_id", 1.0, 1.0, 3, 0.5), (2, None, "none", 0.0, 0.0, 3, 0.1)], "query_id long, rank int, matched_by string, reciprocal_rank double, recall double, n_retrieved int, density double")
    failed = spark.createDataFrame([("low_rank", 1)], "failure string, n long")
    first, second = (files.write_run(f"file://{tmp_path}", "run", metrics, cases, failed) for _ in range(2))
    assert (first[-3:], second[-7:]) == ("run", "run-001")
    lost = spark.read.json(f"{second}/failures.jsonl").collect()
    assert [(r["query_id"], json.loads(r["metadata"])) for r in lost] == [(2, {"density": 0.1})]
    text = "\n".join(r["value"] for r in spark.read.text(f"{second}/summary.md").collect())
    assert "| recall | 0.5 |" in text and "| mrr | - |" in text and "| low_rank | 1 |" in text


def test_chunks_are_checked(spark):
    rows = spark.createDataFrame([("a", "t", "3", "text/plain", "x")], "id string, text string, index string, media_type string, start_char string")
    row = files.normal_chunks(rows).first()
    assert (row["chunk_id"], row["document_id"], row["source_path"], row["chunk_index"], row["start_char"], row["strategy"]) == ("a", "unknown", "unknown", 3, None, "simple")
    for wrong, said in ((rows.withColumn("media_type", F.lit("image/png")), "unknown media type"), (rows.withColumn("text", F.lit(None).cast("string")), "lacks its id or text")):
        with pytest.raises(Exception, match=said):
            files.normal_chunks(wrong).collect()


def test_skipped_files(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_documents(spark, f"file://{tmp_path}/none")
    (tmp_path / "x.bin").write_text("x")
    with pytest.raises(ValueError, match="no supported file"):
        files.read_documents(spark, f"file://{tmp_path}")
    (tmp_path / ".plinth").mkdir()
    (tmp_path / ".plinth" / "y.md").write_text("own")
    (tmp_path / "z.md").write_text("z")
    documents_, skipped = files.read_documents(spark, f"file://{tmp_path}")
    assert documents_.count() == 1 and [r[0] for r in skipped.collect()] == ["x.bin"]
    assert [r["relative_path"] for r in files.evidence_files(files.scan(spark, f"file://{tmp_path}")).collect()] == ["z.md"]


def test_session_store(spark, tmp_path):
    kind = "session_id long, turn int, role string, text string"
    files.write_sessions(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], kind), f"file://{tmp_path}/s")
    files.write_sessions(spark.createDataFrame([(2, 0, "user", "new")], kind), f"file://{tmp_path}/s")
    turns = files.read_sessions(spark, f"file://{tmp_path}/s")
    assert sorted(tuple(r) for r in turns.select("session_id", "turn", "text").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "new")]
    updated = spark.createDataFrame([(1, 5), (2, 9)], "session_id long, updated_at long")
    assert [r["text"] for r in files.latest_session(turns, updated).collect()] == ["new"]


def test_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], CHUNK)
    vectors = spark.createDataFrame([("a", [1.0, 2.0], "raw"), ("b", [1.0, 0.0], "raw")], "chunk_id string, embedding array<double>, representation string")
    name = snapshots.commit(folder, chunks, vectors, manifest={"model": "hash"})
    assert snapshots.manifest_of(spark, folder) == {"model": "hash", "snapshot_id": name, "n_vectors": "2", "dimensions": "2"}
    for wrong in (vectors.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("chunk_id") == "a", 1).otherwise(2))), vectors.withColumn("representation", F.col("chunk_id"))):
        with pytest.raises(ValueError, match="differ"):
            snapshots.commit(folder, chunks, wrong)
    assert snapshots.active(spark, folder)["snapshot_id"] == name


def test_only_one_commit_wins(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    first = snapshots.commit(folder, spark.createDataFrame([("a", "x")], CHUNK))
    monkeypatch.setattr(snapshots, "active", lambda *_: None)  # as if it had looked before the first was there
    with pytest.raises(ValueError, match="faster"):
        snapshots.commit(folder, spark.createDataFrame([("b", "y")], CHUNK))
    monkeypatch.undo()
    assert snapshots.active(spark, folder)["snapshot_id"] == first


def test_streams(spark, sf_dir, tmp_path):
    chunks = stream_chunks(spark, f"{sf_dir}/documents.parquet", f"file://{tmp_path}/c")
    want = sliding_chunks(documents(spark, sf_dir).withColumn("text", F.col("text")))
    assert chunks.select("chunk_id", "text").exceptAll(want.select("chunk_id", "text")).isEmpty() and chunks.count() == want.count()
    got = stream_windows(spark, f"{sf_dir}/events.parquet", f"file://{tmp_path}/w")
    plain = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert got.select("window_start", "event_type", "n").exceptAll(plain).isEmpty() and got.count() == plain.count()


def test_sessions_as_a_stream(spark, tmp_path):
    """Appended, renamed, deleted and begun again, with a restart after every batch."""
    from plinth.streaming import sessions

    folder = f"file://{tmp_path}"
    batches = [
        [(1, 0, "turn", 0, "user", "hello there"), (1, 1, "turn", 1, "assistant", "hi"), (2, 0, "turn", 0, "assistant", "first"), (3, 0, "turn", 5, "user", "later title"), (3, 1, "turn", 6, "user", None)],
        [(1, 2, "turn", 2, "user", "x" * 60), (2, 1, "turn", 1, "user", "y" * 60), (3, 2, "turn", 2, "user", "earlier title"), (4, 0, "turn", 0, "user", "gone soon")],
        [(1, 3, "rename", None, None, "my title"), (4, 1, "delete", None, None, None), (2, 2, "delete", None, None, None), (2, 3, "turn", 0, "user", "again")],
        [(1, 4, "turn", 3, "assistant", "more")],
    ]
    want = [
        {1: (2, 1, 13, "hello there"), 2: (1, 0, 5, None), 3: (2, 2, 11, "later title")},
        {1: (3, 2, 73, "hello there"), 2: (2, 1, 65, "y" * 40), 3: (3, 3, 24, "earlier title"), 4: (1, 1, 9, "gone soon")},
        {1: (3, 2, 73, "my title"), 2: (1, 1, 5, "again"), 3: (3, 3, 24, "earlier title")},
        {1: (4, 2, 77, "my title"), 2: (1, 1, 5, "again"), 3: (3, 3, 24, "earlier title")},
    ]
    for k, (rows, found) in enumerate(zip(batches, want, strict=True)):
        spark.createDataFrame(rows, sessions.EVENT).coalesce(1).write.parquet(f"{folder}/events/{k}")
        events = spark.readStream.schema(sessions.EVENT).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
        got = sessions.run(spark, events, folder)
        assert {r["session_id"]: tuple(r)[1:] for r in got.collect()} == found

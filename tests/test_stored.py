"""Stored indexes, percentiles by selection, the paged source and committed generations."""

import gzip
import json
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth import catalog
from plinth.operators import chunking, evaluate, evidence, gates, leakage, prepared, quantiles, retrieval, vector_index
from plinth.operators.numbering import running
from plinth.plans import trials
from plinth.plans.search_plans import cases_of
from plinth.plans.text_plans import chunks_of
from plinth.sources import generations, paged
from plinth.sources.embedding_cache import EmbeddingCache


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(df):
    return [(q, r, c, round(s, 6)) for q, r, c, s in rows(df.select("query_id", "rank", "chunk_id", "score"))]


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return prepared.Index(spark, prepared.write(chunks_of(spark, sf_dir), buckets=16))


@pytest.mark.parametrize("limit", [0, 1, 10])
def test_index_finds_what_searching_all_texts_finds(spark, sf_dir, index, limit):
    chunks, queries = chunks_of(spark, sf_dir), cases_of(spark, sf_dir)
    assert close(index.bm25(queries, limit)) == close(retrieval.bm25_search(chunks, queries, limit))
    assert close(index.lexical(queries, limit)) == close(retrieval.lexical_search(chunks, queries, limit))
    assert close(index.bm25(queries, limit, 0.9, 0.3)) == close(retrieval.bm25_search(chunks, queries, limit, 0.9, 0.3))


def test_blocks_of_queries(spark, sf_dir, index, monkeypatch):
    monkeypatch.setattr(prepared, "PAIRS", 300)
    queries = cases_of(spark, sf_dir)
    assert close(index.bm25(queries)) == close(retrieval.bm25_search(chunks_of(spark, sf_dir), queries))


def test_blocks_below_the_threshold_are_skipped(spark, monkeypatch):
    """A rare token is found in its blocks alone, though a common one stands in all."""
    monkeypatch.setattr(prepared, "FIRST", 2)
    monkeypatch.setattr(prepared, "BLOCK", 64)
    texts = [(f"{i:05d}", "common filler words " * 3 + ("needle needle needle" if i // 100 == 7 else "")) for i in range(3000)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "common needle"), (2, "absent"), (3, ""), (4, None), (5, "needle needle filler")], "query_id long, query string")
    own = prepared.Index(spark, prepared.write(chunks))
    assert close(own.bm25(queries)) == close(retrieval.bm25_search(chunks, queries))
    assert 0 < own.report["scored"] < own.report["pairs"] / 2


def test_searches_read_no_text_and_few_buckets(spark, index):
    import pyarrow as pa

    words = pa.array(["the"])
    plan = index.postings(words)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", plan) and "entries" not in plan and "text" not in plan
    assert index.chunks.columns == ["number", "chunk_id", "length"]


def test_index_of_odd_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", None), ("c", ""), ("d", "ONE Ünder_score 東京"), ("e", "x " * 40_000 + "one")], "chunk_id string, text string")
    own = prepared.Index(spark, prepared.write(chunks))
    queries = spark.createDataFrame([("q", "one x"), ("r", "東京 two two"), ("s", "?")], "query_id string, query string")
    assert close(own.bm25(queries)) == close(retrieval.bm25_search(chunks, queries))
    assert rows(own.statistics()) == rows(retrieval.corpus_statistics(chunks))
    none = prepared.Index(spark, prepared.write(chunks.limit(0)))
    assert none.bm25(queries).count() == 0 and none.statistics().first()["n_chunks"] == 0
    os.makedirs(tmp_path / "unfinished/chunks")
    with pytest.raises(Exception, match="stats"):
        prepared.Index(spark, f"file://{tmp_path}/unfinished")


def test_words_cut_from_bytes_are_those_of_the_expression(spark):
    """All kinds of code points, words at the ends of texts, empty texts, null, and a slice of an array."""
    import pyarrow as pa

    from plinth.functions.text import tokens
    from plinth.functions.words import word_points, words

    points = [*range(1, 0xD800, 7), *range(0xE000, 0x110000, 997)]
    texts = ["", "a", "b c", "", None, "ÄÖ_1 ΣΑΣ İx ǅ 東京tower", "end", "_", " . ", "".join(map(chr, points)), " ".join(map(chr, points)), "é", ""]
    held = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", F.lower(F.coalesce("text", F.lit(""))).alias("lower"), tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = held.orderBy("i").toArrow()
    lower = found["lower"].combine_chunks().cast(pa.string())
    assert words(lower, word_points(spark)).to_pylist() == found["tokens"].to_pylist()
    assert words(lower.slice(2, 8), word_points(spark)).to_pylist() == found["tokens"].to_pylist()[2:10]
    assert words(lower.slice(0, 0), word_points(spark)).to_pylist() == []


def test_an_index_is_made_in_one_pass_over_the_texts(spark, tmp_path):
    """The texts are read, cut and counted once, and postings are no more rows than (bucket, block) pairs of the batches, whatever tokens they have."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(f"{i:05d}", " ".join(f"w{(i * j) % 977}" for j in range(60))) for i in range(2500)], "chunk_id string, text string").repartition(2)
    folder = prepared.write(texts.mapInArrow(count, texts.schema), buckets=8)
    assert seen.value == 2500
    held = spark.read.parquet(f"{folder}/postings")
    assert held.count() <= 8 * 2 * 2 and set(held.columns) == {"bucket", "block", "tokens", "facts", "entries"}
    assert spark.read.parquet(f"{folder}/chunks").columns == ["number", "chunk_id", "length"]


def want(values, share):
    return float(np.percentile(values, 100 * share)) if len(values) else None


@pytest.mark.parametrize(("small", "pivots"), [(10_000, 100), (40, 100), (5, 4), (1, 3)])
def test_percentiles(spark, monkeypatch, small, pivots):
    """Whatever is selected and what is sorted: ties, outliers, nulls, null groups, and groups of any size."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "PIVOTS", pivots)
    rng = random.Random(3)
    groups = {
        "even": [float(i) for i in range(500)], "ties": [1.0] * 300 + [2.0] * 300 + [3.0], "one value": [7.0] * 400, "far": [rng.choice((1, -1)) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        None: [rng.gauss(0, 1) for _ in range(333)], "few": [3.0, 1.0], "single": [5.0], "nothing": [None, None], "some nulls": [None, 4.0, 8.0] * 60,
    }
    data = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in quantiles.percentiles(df, "v", shares, "g").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        held = [v for v in vs if v is not None]
        assert got[g]["n"] == len(held)
        for name, share in shares.items():
            assert got[g][name] == (pytest.approx(want(held, share), rel=1e-12) if held else None), (g, name)
    whole = [v for _, v in data if v is not None]
    row = quantiles.percentiles(df, "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (row["n"], row["p50"], row["p99"]) == (len(whole), pytest.approx(want(whole, 0.5)), pytest.approx(want(whole, 0.99)))
    assert rows(quantiles.percentiles(df.limit(0), "v", {"p50": 0.5})) == [(0, None)] and quantiles.percentiles(df.limit(0), "v", {"p50": 0.5}, "g").count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(df, "v", {"p": 1.5})


@pytest.mark.parametrize("key", ["name", "rank", "value"])
def test_percentiles_by_any_column_name(spark, monkeypatch, key):
    """Large groups whose column is named as one of the search's own; ``name`` is that of stage_latencies."""
    monkeypatch.setattr(quantiles, "SMALL", 20)
    df = spark.createDataFrame([(g, float(i)) for g in ("a", "b") for i in range(50)] + [("c", 1.0)], f"{key} string, v double")
    got = {r[key]: (r["p50"], r["p95"]) for r in quantiles.percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, key).collect()}
    assert got == {"a": (24.5, pytest.approx(46.55)), "b": (24.5, pytest.approx(46.55)), "c": (1.0, 1.0)}
    if key == "name":
        stages = df.select(key, F.col("v").alias("latency_ms"))
        assert {tuple(r) for r in evaluate.stage_latencies(stages).collect()} == {("a", 50, 24.5, 24.5, 46.55), ("b", 50, 24.5, 24.5, 46.55), ("c", 1, 1.0, 1.0, 1.0)}


def test_latencies_of_one_group_with_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 50)
    values = [float(i * i % 1009) for i in range(5000)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = evaluate.latencies(df, "v", "g").first()
    assert (row["n"], row["p50"], row["p95"], row["maximum"]) == (5000, want(values, 0.5), pytest.approx(want(values, 0.95)), max(values))
    samples = [(t, s, float((s * 37 + t) % 101)) for t in range(3) for s in range(400)]
    found = gates.cold_and_warm(spark.createDataFrame(samples, "trial int, seq int, latency_ms double")).first()
    warm = [v for _, s, v in samples if s]
    assert tuple(found) == pytest.approx((np.mean([v for _, s, v in samples if not s]), np.mean(warm), want(warm, 0.5), want(warm, 0.95)))


PAGES = [{"document_id": d, "page": p, "words": [[10.0 * k, 10.0 * k + 8, 12.0 * p, f"w{d}-{p}-{k} é\n"] for k in range(d % 4)]} for d in range(40) for p in range(5)]


@pytest.mark.parametrize("step", [1, 37, 1000, 1 << 20])
def test_paged_source(spark, tmp_path, step):
    """Every page once, wherever the ranges cut the files."""
    for k in range(3):
        with open(tmp_path / f"part-{k}.jsonl", "w", encoding="utf-8") as file:
            file.write("\n\n".join(json.dumps(p, ensure_ascii=k == 1) for p in PAGES[k::3]) + ("\n" if k else ""))
    (tmp_path / "_SUCCESS").write_text("not a page")
    spark.dataSource.register(paged.PagedSource)
    if step == 1:  # a task a byte would be many
        reader = paged.PagedReader({"path": str(tmp_path / "part-0.jsonl"), "rangeBytes": "1"})
        got = [tuple(r.values()) for part in reader.partitions()[:3000] for b in reader.read(part) for r in b.to_pylist()]
        assert got == [(p["document_id"], p["page"], *w) for p in PAGES[::3] for w in p["words"]][: len(got)] and len(got) > 20
        return
    df = spark.read.format("paged_words").option("path", f"file://{tmp_path}").option("rangeBytes", step).load()
    assert rows(df) == sorted(((p["document_id"], p["page"], *w) for p in PAGES for w in p["words"]), key=repr)


def test_paged_source_packed_and_compressed(spark, tmp_path):
    """A row a page, of either form of line, from plain and compressed files."""
    one = [{"document_id": 1, "page": p, "words": [[float(w), w + 1, 0.5, f"wörd {w}"] for w in range(p % 3)]} for p in range(50)]
    two = [{"document_id": 2, "page": p, "x0": [1, 2.5], "x1": [2.0, 3], "top": [0, 0], "text": ["a", None]} for p in range(50)]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, one)))
    with gzip.open(tmp_path / "two.jsonl.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, two)))
    spark.dataSource.register(paged.PagedSource)
    load = spark.read.format("paged_words").option("path", str(tmp_path)).option("rangeBytes", 100)
    want = [(1, p, float(w), w + 1.0, 0.5, f"wörd {w}") for p in range(50) for w in range(p % 3)] + [(2, p, *w) for p in range(50) for w in ((1.0, 2.0, 0.0, "a"), (2.5, 3.0, 0.0, None))]
    packed = load.option("packed", "true").load()
    assert packed.count() == 50 + sum(p % 3 > 0 for p in range(50))
    assert rows(packed.select("document_id", "page", F.inline("words"))) == rows(load.option("packed", "false").load()) == sorted(want, key=repr)
    (tmp_path / "three.jsonl").write_text(json.dumps({"document_id": 3, "page": 0, "x0": [1], "x1": [2, 3], "top": [0], "text": ["a"]}))
    with pytest.raises(Exception, match="no page"):
        load.load().collect()


class Backwards(paged.JsonPages):
    """A decoder of another format: each line is a page, the words reversed; one range a file."""

    def ranges(self, size, step):
        return [(0, size)]

    def pages(self, file, first, end):
        for line in file.read().decode().splitlines():
            yield 1, 0, [[0, 1, 2, line[::-1]]]


def test_decoders_and_damaged_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("cba\nfed\n")
    spark.dataSource.register(paged.PagedSource)
    load = spark.read.format("paged_words").option("path", str(tmp_path))
    assert [r["text"] for r in load.option("decoder", "tests.test_stored:Backwards").load().collect()] == ["abc", "def"]
    with pytest.raises(Exception, match="no page"):
        spark.read.format("paged_words").option("path", str(tmp_path)).load().collect()
    os.makedirs(tmp_path / "empty")
    assert spark.read.format("paged_words").option("path", str(tmp_path / "empty")).load().count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("paged_words").load().collect()


def test_generations(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    assert generations.current(folder) is None
    first = generations.write(spark.range(1000).withColumn("v", F.col("id") * 2), folder, "id", 1000)
    assert first["rows"] == 1000 and generations.read(spark, folder).agg(F.sum("v")).first()[0] == 999_000
    second = generations.write(spark.range(10), folder, "id")
    assert second["generation"] != first["generation"] and generations.read(spark, folder).count() == 10
    assert generations.damaged(spark, folder).count() == 0
    with open(f"{tmp_path}/g/{second['files'][0]['file']}", "ab") as file:
        file.write(b"x")
    assert [r["file"] for r in generations.damaged(spark, folder).collect()] == [second["files"][0]["file"]]
    os.remove(f"{tmp_path}/g/{second['files'][-1]['file']}")
    assert {r["found"] for r in generations.damaged(spark, folder).collect()} >= {"missing"}


def test_a_failed_generation_leaves_the_pointer(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    kept = generations.write(spark.range(100), folder, "id")
    before = sorted(os.listdir(tmp_path / "g"))
    bad = {
        "occurs twice": (spark.range(50).union(spark.range(1)), None),
        "not 7": (spark.range(5), 7),
        "boom": (spark.range(100).select(F.when(F.col("id") < 60, F.col("id")).otherwise(F.raise_error(F.lit("boom")).cast("long")).alias("id")), None),
        "key is null": (spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("id")), None),
    }
    for message, (df, expected) in bad.items():
        with pytest.raises(Exception, match=message):
            generations.write(df, folder, "id", expected)
        assert generations.current(folder) == kept and sorted(os.listdir(tmp_path / "g")) == before, message
    spark.dataSource.register(generations.GenerationSource)
    overlapping = spark.range(100).repartition(4, F.col("id") % 4).sortWithinPartitions("id")
    with pytest.raises(Exception, match="overlap"):
        overlapping.write.format("generation").option("path", folder).option("key", "id").mode("append").save()
    with pytest.raises(Exception, match="sorted"):
        spark.range(100).coalesce(1).orderBy(F.desc("id")).write.format("generation").option("path", folder).option("key", "id").mode("append").save()
    assert generations.current(folder) == kept and generations.read(spark, folder).count() == 100


def vectors_of(spark, matrix, name, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize(("block", "first"), [(1 << 13, 2), (7, 1), (50, 3)])
def test_vector_index_finds_what_comparing_all_finds(spark, monkeypatch, block, first):
    """Clusters, copies, zero vectors and opposite ones, whatever the parts."""
    monkeypatch.setattr(vector_index, "BLOCK", block)
    monkeypatch.setattr(vector_index, "FIRST", first)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = np.concatenate([centres[rng.integers(0, 12, 400)] + 0.05 * rng.normal(size=(400, 16)), np.repeat(centres[:1], 150, axis=0), np.zeros((3, 16)), -centres, rng.normal(size=(40, 16))])
    asked = np.concatenate([data[::23], np.zeros((1, 16)), -data[:2]])
    index, queries = vectors_of(spark, data, "chunk_id"), vectors_of(spark, asked, "query_id")
    own = vector_index.VectorIndex(spark, vector_index.write(index))
    for limit in (1, 10, 1000):
        assert close(own.search(queries, limit)) == close(retrieval.semantic_search(index, queries, limit))
        assert own.report["scored"] <= own.report["pairs"]
        if limit == 1 and block > 7:
            assert own.report["scored"] < own.report["pairs"] / 2
    assert own.search(queries, 0).count() == 0 and own.search(queries.limit(0)).count() == 0
    assert vector_index.VectorIndex(spark, vector_index.write(index.limit(0))).search(queries).count() == 0
    with pytest.raises(Exception, match="length"):
        own.search(vectors_of(spark, rng.normal(size=(2, 5)), "query_id")).collect()


@pytest.mark.parametrize(("size", "overlap", "split", "stretch"), [(60, 10, True, 1 << 20), (60, 10, True, 200), (25, 0, False, 100), (1000, 100, True, 5000)])
def test_large_documents_are_packed_as_small_ones(spark, monkeypatch, size, overlap, split, stretch):
    """Tables, long and empty blocks, several documents; what the folding of a row gives."""
    monkeypatch.setattr(chunking, "STRETCH", stretch)
    rng, data = random.Random(size), []
    for d in range(4):
        at = 0
        for k in range((400, 1, 150, 2)[d]):
            n = rng.choice([0, 1, 3, 8, 20, 24, 25, 26, 58, 60, 61, 200])
            data.append((d, 3 * k, rng.choice(["paragraph", "paragraph", "list", "table"]), "".join(rng.choices("abc ", k=n)), at, at + n, k // 7, ["a"] * (k % 2)))
            at += n + 2
    blocks = spark.createDataFrame(data, "document_id long, block_index int, block_type string, text string, start_char int, end_char int, page_number int, heading_path array<string>")
    want = rows(chunking.block_chunks(blocks, size, overlap, split))
    assert rows(chunking.block_chunks_of_any_size(blocks, size, overlap, split, large=0)) == want
    assert rows(chunking.block_chunks_of_any_size(blocks, size, overlap, split, large=149)) == want
    assert rows(chunking.block_chunks_of_any_size(blocks, size, overlap, split)) == want


def test_large_documents_are_packed_without_the_driver(spark, monkeypatch):
    """Numbers of blocks, stored compressed, are merged, not sent, and texts don't go with them."""
    kept, plans = chunking.stored, []

    def seen(df, name):
        if name in ("placed", "jumps", "begun"):
            plans.append(("text" in df.columns, "BroadcastHashJoin [document_id" in df._jdf.queryExecution().executedPlan().toString() and name != "placed"))
        return kept(df, name)

    monkeypatch.setattr(chunking, "stored", seen)
    blocks = spark.range(30).selectExpr("id % 2 document_id", "cast(id as int) block_index", "'paragraph' block_type", "'some text' text", "0 start_char", "9 end_char")
    assert chunking.block_chunks_of_any_size(blocks, 60, large=0).count() == 6
    assert len(plans) > 4 and not any(map(any, plans))


def test_running_sums_of_one_group_over_many_ranges(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 3).alias("v"))
    got = running(df, ["g"], ["id"], {"before": "v"}, parts=7).orderBy("id").collect()
    assert [r["before"] for r in got] == [sum(i % 3 for i in range(n)) for n in range(1000)]


def test_embedding_cache(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/cache", tmp_path / "calls"
    calls.mkdir()

    def counting(width):
        def embed(texts):
            for t in texts:
                (calls / f"{len(os.listdir(calls)):06d}-{os.getpid()}-{abs(hash(t))}").write_text(t)
            return [[float(len(t))] * width for t in texts]

        return embed

    chunks = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "chunk_id long, text string")
    cache = EmbeddingCache(spark, folder, {"model": "m", "dimensions": "2"})
    first = rows(cache.embed(chunks, counting(2)))
    assert (cache.asked, cache.found, len(os.listdir(calls))) == (3, 0, 3) and [r[0] for r in first] == [1, 2, 3, 4, 5]
    assert rows(cache.embed(chunks, counting(2))) == first and (cache.asked, cache.found, len(os.listdir(calls))) == (0, 3, 3)
    again = EmbeddingCache(spark, folder, {"dimensions": "2", "model": "m"})
    again.compact()
    assert again.known().count() == 3
    more = chunks.union(spark.createDataFrame([(6, "ccc")], "chunk_id long, text string"))
    assert again.embed(more, counting(2)).count() == 6 and (again.asked, again.found, len(os.listdir(calls))) == (1, 3, 4)
    assert rows(cache.embed(more, counting(2)))[-1][2] == [3.0, 3.0] and cache.asked == 0
    with pytest.raises(Exception, match="length"):
        cache.embed(spark.createDataFrame([(7, "dddd")], "chunk_id long, text string"), counting(3))
    assert cache.embed(more, counting(2)).count() == 6 and cache.asked == 0
    other = EmbeddingCache(spark, folder, {"model": "n", "dimensions": "2"})
    assert other.embed(chunks, counting(3)).count() == 5 and other.asked == 3
    assert other.embed(chunks.limit(0), counting(3)).count() == 0


def test_trials_are_resumed(spark, tmp_path):
    made = []

    def run(cell):
        made.append(cell)
        return spark.range(cell["k"]).select("id", (F.col("id") * 2).alias("v"))

    matrix = trials.TrialMatrix(spark, f"file://{tmp_path}", {"cases": "x"}, "id", run)
    cells = [{"mode": m, "k": k} for m in ("a", "b") for k in (3, 50)] + [{"mode": "a", "k": 0}]
    want = rows(matrix.complete(cells))
    assert len(made) == 5 == len(matrix.ran) and len(want) == 106
    assert rows(matrix.complete(cells)) == want and not matrix.ran and len(made) == 5
    damaged, gone = matrix.name(cells[1]), matrix.name(cells[2])
    file = damaged.removeprefix("file://") + "/" + generations.current(damaged)["files"][0]["file"]
    with open(file, "r+b") as f:
        f.seek(8)
        f.write(b"!")
    os.remove(gone.removeprefix("file://") + "/" + generations.POINTER)
    assert [matrix.state(c) for c in cells] == ["done", "damaged", "missing", "done", "done"]
    assert rows(matrix.complete(cells)) == want and matrix.ran == [cells[1], cells[2]]
    matrix.complete([*cells, {"mode": "c", "k": 1}])
    assert matrix.ran == [{"mode": "c", "k": 1}]
    other = trials.TrialMatrix(spark, f"file://{tmp_path}", {"cases": "y"}, "id", run)
    other.complete(cells[:1])
    assert other.ran == cells[:1]
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    assert trials.digest_of(df, "id", "t") == trials.digest_of(df.orderBy(F.desc("id")).repartition(3), "id", "t") != trials.digest_of(df.distinct(), "id", "t")


def test_trials_without_results(spark, sf_dir, tmp_path):
    """Cells that find nothing count as none, as in the SQL; an unreadable manifest is damage, not an error."""
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("true" if name == "documents" else "false").write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["trial_matrix"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(catalog.SQL["trial_matrix"])
    columns = [d[0] for d in want.description]
    assert rows(got.select(*columns)) == sorted(want.fetchall(), key=repr) == sorted([(m, k, 0, 0, 0, 4, 0) for m in ("lexical", "bm25") for k in (1, 5)], key=repr)
    matrix = trials.TrialMatrix(spark, f"file://{tmp_path}/trials", {"cases": "x"}, "id", lambda cell: spark.range(cell["k"]))
    cells = [{"k": 0}, {"k": 2}]
    empty = matrix.complete(cells[:1])
    assert empty.columns == ["id", "k"] and empty.count() == 0
    assert rows(matrix.complete(cells)) == [(0, 2), (1, 2)] and matrix.ran == cells[1:]
    name = matrix.name(cells[1]).removeprefix("file://")
    os.remove(f"{name}/{generations.current(name)['generation']}/{generations.MANIFEST}")
    assert [matrix.state(c) for c in cells] == ["done", "damaged"]
    assert rows(matrix.complete(cells)) == [(0, 2), (1, 2)] and matrix.ran == cells[1:]
    generations.forget(name)
    assert matrix.state(cells[1]) == "missing"


def test_farthest_points_of_many_groups(spark):
    rng = random.Random(2)
    data = [(g, i, float(rng.randint(0, 30))) for g in ("a", None, "c", "one") for i in range(1 if g == "one" else 40)]
    got = {}
    for r in gates.farthest(spark.createDataFrame(data, "g string, id long, position double"), 6, "g").orderBy("place").collect():
        got.setdefault(r["g"], []).append(r["id"])
    for g in ("a", None, "c", "one"):
        points = {i: p for k, i, p in data if k == g}
        chosen = [0]
        while len(chosen) < min(6, len(points)):
            chosen.append(max((i for i in points if i not in chosen), key=lambda i: (min(abs(points[i] - points[c]) for c in chosen), -i)))
        assert got[g] == chosen


def test_leakage_finds_every_near_text(spark):
    """Against comparing all with all: copies, near copies, short and empty texts, crowds of equal ones."""
    rng, texts = random.Random(9), []
    words = [f"w{i}" for i in range(40)]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([0, 1, 3, 6, 30, 80]))
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += ["same again and again and again"] * 30 + [None]
    data = [(i, t) for i, t in enumerate(texts)]
    held, others = data[::3], data[1::3] + data[2::3] + [(0, "another text under a known id")]

    def of(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    want = []
    for i, t in held:
        near = [len(of(t) & of(u)) / len(of(t) | of(u)) for _, u in others if of(t) and of(u)]
        near = [x for x in near if x >= 0.8]
        want.append((i, i == 0, sum((t or "") == (u or "") for _, u in others), len(near), round(max(near), 9) if near else None))
    kind = "id long, text string"
    got = leakage.leakage(spark.createDataFrame(held, kind), spark.createDataFrame(others, kind)).withColumn("closest", F.round("closest", 9))
    assert rows(got) == sorted(want, key=repr) and sum(w[3] > 0 for w in want) > 10
    assert leakage.leakage(spark.createDataFrame(held, kind), spark.createDataFrame([], kind)).where("n_near > 0").count() == 0


def test_leakage_shuffles_prefixes_alone(spark, monkeypatch):
    """Sets are stored once; what is grouped and joined are their prefixes and the pairs that meet."""
    kept, sizes = leakage.stored, {}

    def seen(df, name):
        out = kept(df, name)
        sizes[name] = [r["n"] for r in out.select(F.size([c for c in ("set", "prefix") if c in out.columns][0]).alias("n")).collect()] if name != "pairs" else out.count()
        return out

    monkeypatch.setattr(leakage, "stored", seen)
    words = [[f"w{d}x{i}" for i in range(104)] for d in range(8)]
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(words)] + [(9, " ".join(words[0][:102] + ["new"])), (10, " ".join(words[1]))], "id long, text string")
    got = rows(leakage.leakage(texts.where("id < 8"), texts.where("id > 8")))
    assert [r[2:4] for r in got[:3]] == [(0, 1), (1, 1), (0, 0)]
    assert {*sizes["shingles"]} == {100, 99} and max(sizes["classes"]) == 21 and sizes["pairs"] == 2 and len(sizes["sets"]) == 4


@pytest.mark.parametrize(("name", "counts", "seeks"), [("mode_comparison", 1, 1), ("transitions", 1, 1), ("engine_compare", 1, 1), ("direction_gates", 1, 1), ("trial_matrix", 1, 0), ("fragment_gates", 1, 0), ("retrieval_metrics", 1, 1)])
def test_passes_over_the_texts_are_shared(spark, sf_dir, monkeypatch, name, counts, seeks):
    """Texts are tokenised once for all searches, passages are sought once for all that needs their places."""
    done = []
    for module, step in ((retrieval, "counted_tokens"), (evidence, "find_passages")):
        monkeypatch.setattr(module, step, lambda *a, own=getattr(module, step), step=step: (done.append(step), own(*a))[1])
    catalog.QUERIES[name](spark, sf_dir)
    assert (done.count("counted_tokens"), done.count("find_passages")) == (counts, seeks)

"""Token files, ranked search and importance resampling against brute force and exact round trips."""

import io
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import ranked_search, resampling, token_files
from plinth.llm.common import benchmark, documents
from tests.llm.conftest import ordered

KIND = "long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize(
    "ids",
    [
        [0], [2**64 - 2, 5, 2**60 - 1, 2**60 - 2, 2**59, 0, 1, 2**32, 2**31] * 50, [0] * 1000, [1, 2**40] * 3, list(range(70_000)), [50_256] * 59, [0] * 59 + [7], [2**32 - 2, 2**32 - 1, 2**33] * 2,
        np.random.default_rng(1).integers(0, 50_257, 65_536).tolist(), (np.random.default_rng(2).zipf(1.2, 65_536) % 2**62).tolist(),
    ],
)
def test_blocks(ids):
    ids = np.array(ids, np.uint64)
    words, escapes = token_files.encode_block(ids)
    assert (token_files.decode_block(words, escapes, len(ids)) == ids).all()
    assert 8 * len(words) + 8 * len(escapes) <= 8 * len(ids) + 8


def test_a_rare_large_id_is_an_escape():
    ids = np.full(6000, 3, np.uint64)
    ids[::1000] = 2**50
    words, escapes = token_files.encode_block(ids)
    assert len(escapes) == 6 and len(words) == 300  # three bits, twenty codes to a word


class File(io.BytesIO):
    """A file in memory, as pyarrow's file systems give them."""

    def close(self):
        pass

    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        self.read_from = min(getattr(self, "read_from", at), at)
        return self.getvalue()[at : at + n]


def test_ranges_are_read_without_the_blocks_before():
    rng, file = np.random.default_rng(3), File()
    writer, ids = token_files.Writer(file, pa.int64()), rng.integers(0, 50_257, 400_000)
    writer.add(pa.array([1, None]), np.array([300_000, 0]), ids[:300_000])
    writer.add(pa.array([7]), np.array([100_000]), ids[300_000:])
    assert writer.close() == file.size()
    reader = token_files.Reader(file)
    assert reader.docs.to_pydict() == {"doc_id": [1, None, 7], "n": [300_000, 0, 100_000]} and reader.total == 400_000
    for start, count in ((390_000, 500), (330_000, 65_536), (399_999, 5), (65_535, 2), (0, 400_000)):
        file.read_from = file.size()
        assert (reader.read(start, count) == ids[start : start + count]).all()
        assert file.read_from == reader.offsets[start // token_files.BLOCK_IDS]
    assert len(reader.read(400_000, 5)) == 0
    with pytest.raises(ValueError):
        token_files.Reader(File(b"x" * 100))


ALPHABET = [
    " ", "  ", "\n", "\r\n", "\t", "\nA", "a", "B", "ing", "é", "ê", "ß", "Ĳ", "ɏ", "×", "日", "1", "²", "'", "'s", "'t", "'re", "'LL", "!", "...", "_", " ", "　", " ", "᠎", " ", "​", "́", "\u0085",
    "\x1c", "\x00", "\x7f", "𝒳", "’", "<|endoftext|>", "don't", "  x", "\n\n", "\n \n",
]


def test_pieces_give_the_ids_of_whole_texts(tokenizer, sf_dir):
    import pandas as pd

    rnd = random.Random(4)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 30))) for _ in range(4000)] + ["", "x" * 20_000, "é" * 9000, "\n" * 5000, "' " * 3000] + pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        n, ids = token_files.Encoder(file.read()).encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def brute_files(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text), which come in the files' order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, sf_dir, tokenizer):
    docs = documents(spark, sf_dir)
    want = brute_files(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), tokenizer)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows make one file
    manifest = token_files.write(docs)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert ordered(tuple(r) for r in token_files.digests(manifest, KIND).collect()) == ordered(want)
    read = {r["doc_id"]: r for r in token_files.read(manifest, KIND).collect()}
    assert {d: (r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for d, r in read.items()} == {d: x for d, *rest in want for x in [tuple(rest)]}
    assert manifest.agg(F.sum("n_ids")).first()[0] == sum(x[2] for x in want) and manifest.count() > 1


def test_token_files_of_odd_rows(spark, odd, empty, tokenizer):
    got = sorted((tuple(r) for r in token_files.digests(token_files.write(odd), KIND).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: (d is not None, d))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, n, c) for d, _, n, c in brute_files([(r["doc_id"], r["text"]) for r in odd.collect()], tokenizer))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert token_files.digests(token_files.write(empty), KIND).count() == 0 and token_files.read(token_files.write(empty), KIND).count() == 0
    named = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert token_files.digests(token_files.write(named), "string").count() == odd.count()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_search(docs, items, limit=10):
    """The ranking by its formula, one document after another; docs and items are (id, text)."""
    rows = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    rows = [(d, c) for d, c in rows if c]
    n, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in rows:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:limit])]
    return out


@pytest.mark.parametrize(("tile", "terms", "pairs"), [(512, 2048, 1 << 18), (3, 7, 40)])
def test_ranked_search(spark, sf_dir, monkeypatch, tile, terms, pairs):
    """Whatever the tiles and blocks of items."""
    for name, value in (("TILE", tile), ("TERMS", terms), ("PAIRS", pairs)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = documents(spark, sf_dir), benchmark(spark, sf_dir).where("item_id < 12")
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert ordered(tuple(r) for r in ranked_search.search(docs, items).collect()) == ordered(want)


def test_ranked_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "Fox DOG zoë’s"), (1, "river"), (2, None), (3, ""), (None, "x of17 日本語"), (4, "nowhere2 found2"), (5, "a")], "item_id long, text string")
    want = brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in items.collect()])
    assert ordered(tuple(r) for r in ranked_search.search(odd, items.withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("s"))).collect()) == ordered(want)
    assert ranked_search.search(empty, items).count() == 0 and ranked_search.search(odd, items.limit(0)).count() == 0 and ranked_search.search(odd, items, 0).count() == 0


def test_ties_across_tiles_and_tasks(spark, monkeypatch):
    """Thousands of equal scores: the least ids win, in whatever order the rows come."""
    monkeypatch.setattr(ranked_search, "TILE", 16)
    ids = list(range(3000))
    random.Random(5).shuffle(ids)
    docs = spark.createDataFrame([(d, "same words here" if d % 3 else "other words") for d in ids], "doc_id long, text string").repartition(7)
    got = ranked_search.search(docs, spark.createDataFrame([(1, "same"), (2, "other words")], "item_id int, text string")).orderBy("item_id", "rank").collect()
    assert [r["doc_id"] for r in got] == [d for d in range(3000) if d % 3][:10] + [3 * d for d in range(10)]


def brute_draw(docs, target, run=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for d, n, f in own:
        h = int(sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    k = percent * len(able) // 100
    return [(*(r[i] for i in (0, 2, 3, 4)), i + 1 if i < k else None) for i, r in enumerate(able)] + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < least]


@pytest.mark.parametrize("options", [{}, {"run": 3, "buckets": 64}, {"percent": 100, "least": 0}, {"percent": 0}, {"percent": 50, "seed": 7}])
def test_resampling(spark, sf_dir, options):
    docs, target = documents(spark, sf_dir), benchmark(spark, sf_dir)
    want = brute_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], **options)
    assert ordered(tuple(r) for r in resampling.resample(docs, target, **options).collect()) == ordered(want)


def test_resampling_of_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("the lazy dog and the fox",), (None,), ("",)], "text string").withColumn("doc_id", F.lit("x"))
    rows, texts = [(r["doc_id"], r["text"]) for r in odd.collect()], ["the lazy dog and the fox", None, ""]
    for options in ({"percent": 40}, {"percent": 100, "least": 0}):
        assert ordered(tuple(r) for r in resampling.resample(odd, target, **options).collect()) == ordered(brute_draw(rows, texts, **options))
    assert ordered(tuple(r) for r in resampling.resample(odd, target.limit(0)).collect()) == ordered(brute_draw(rows, []))
    assert resampling.resample(empty, target).count() == 0


@pytest.mark.parametrize("pivots", [1, 4, 15])
def test_quickselect(spark, monkeypatch, pivots):
    """Every rank, with many equal keys and nulls in them."""
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    values = [i % 7 if i % 11 else None for i in range(60)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.struct(F.col("v").isNull().alias("n"), "v").alias("key"))
    order = sorted(values, key=lambda v: (v is None, v or 0))
    for k in (1, 2, 30, 59, 60):
        found = resampling.kth_key(rows, k)
        assert f'"v":{"null" if order[k - 1] is None else order[k - 1]}' in found
    assert resampling.kth_key(rows, 61) is None

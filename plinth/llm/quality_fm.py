"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its lower-cased words, hashed, with damped counts of
unit length; the bins of its structure statistics; and the bin of n_chars. The
score of low-rank pairwise interactions takes time linear in the features, by
the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

The machine is trained in numpy on at most TRAIN_ROWS labelled documents with
TRAIN_BYTES of text together, those whose hashed ids are least, none of them held
out; all of a document's text is used, in training and in scoring. Labels,
language, source and id are never features.

Defined results: null or empty text scores by its empty statistics; a very long
text is scored whole, and learnt from only where it fits into TRAIN_BYTES; a null
n_chars, or none, has a bin of its own; repeated rows give a result each, and of
those of one labelled id the one of the least text hash teaches; a doc_id of any
type that labels share, null too, stays as it is, null is not held out; an empty
table gives an empty result; several labels of a document count as the least;
without both labels the score is the smoothed share of label 1. Other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import held_out, slices, stored, text_of

#: Labelled documents that the machine learns from at most, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 6000, 24 << 20
WORDS, BINS, FACTORS = 1 << 15, 16, 8
#: Passes over the rows, or as many more as STEPS batches take.
EPOCHS, STEPS, BATCH, RATE, SEED = 12, 800, 64, 0.1, 11
THRESHOLD = 0.3
STATISTICS = 13
SIZE = WORDS + BINS * STATISTICS
#: Classes of bytes: 1 capital letters, 2 digits, 3 symbols, 4 marks, 5 other punctuation, 6 beyond ASCII, 7 white space.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>~^_=", b"!?", b".,;:'\"()-", bytes(range(128, 256)), b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _k


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _share(x: float) -> int:
    """The bin of a share between 0 and 1; fine near 0."""
    return min(BINS - 1, int(BINS * x**0.5))


def _logarithm(x: float) -> int:
    return min(BINS - 1, int(x).bit_length())


def featurize(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document."""
    words = text.lower().split()
    counts = Counter(words)
    n, size = max(1, len(words)), max(1, len(text))
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    statistics = [
        *(_share(x) for x in classes[1:7]),
        _logarithm(len(words)),
        min(BINS - 1, size // n),
        _share(len(counts) / n),
        _share(max(counts.values(), default=0) / n),
        _share(sum(map(eq, words, words[1:])) / n),
        _share(1 - len(set(lines)) / max(1, len(lines))),
        0 if n_chars is None or n_chars < 0 else _logarithm(n_chars),
    ]
    hashed = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    at = np.concatenate([hashed, WORDS + BINS * np.arange(STATISTICS) + np.asarray(statistics)])
    values = np.concatenate([values / max(1e-9, float(np.sqrt((values**2).sum()))), np.ones(STATISTICS)])
    return at, values


def logits(machine: Machine, at: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the sigmoid of documents whose features begin at ``starts``; also v_i x_i, and their sums."""
    vx = machine.factors[at] * values[:, None]
    sums = np.add.reduceat(vx, starts)
    pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
    return machine.bias + np.add.reduceat(machine.linear[at] * values, starts) + pairs, vx, sums


def train(at: np.ndarray, values: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Machine:
    """Logistic loss, minimised by Adagrad over shuffled batches; the same input gives the same machine."""
    if not 0 < labels.sum() < len(labels):
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    rng = np.random.default_rng(SEED)
    ends = np.concatenate([starts[1:], [len(at)]])
    linear, factors, bias = np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS)), 0.0
    seen_l, seen_f, seen_b = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(labels)))):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            sizes = ends[rows] - starts[rows]
            first = np.cumsum(sizes) - sizes
            pick = np.repeat(starts[rows] - first, sizes) + np.arange(sizes.sum())
            i, x = at[pick], values[pick]
            z, vx, sums = logits(Machine(bias, linear, factors), i, x, first)
            error = (1 / (1 + np.exp(-z)) - labels[rows]) / len(rows)
            e = np.repeat(error, sizes)
            unique, back = np.unique(i, return_inverse=True)
            grad_l = np.bincount(back, e * x, len(unique)) + 1e-6 * linear[unique]
            step = (e * x)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            grad_f = np.stack([np.bincount(back, step[:, f], len(unique)) for f in range(FACTORS)], axis=1) + 1e-6 * factors[unique]
            seen_l[unique] += grad_l**2
            seen_f[unique] += grad_f**2
            seen_b += error.sum() ** 2
            linear[unique] -= RATE * grad_l / np.sqrt(seen_l[unique])
            factors[unique] -= RATE * grad_f / np.sqrt(seen_f[unique])
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    return Machine(bias, linear.astype(np.float32), factors.astype(np.float32))


def _rows(docs: DataFrame) -> DataFrame:
    n_chars = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", text_of(docs).alias("text"), n_chars.alias("n_chars"))


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [featurize(t, n) for t, n in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("n_chars").to_pylist(), strict=True)]
    sizes = np.asarray([len(x) for x, _ in found])
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """The rows of docs, which has doc_id and text, to learn from, one for each id, with ``label`` and ``hash``, in a written table.

    They are the labelled ones that are not held out, at most ``most``, those whose hashed ids are least; of these, in the same order,
    those whose texts fit into ``most_bytes`` together with the ones before.
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", *rest)).alias("x"))
    first = first.select("doc_id", "label", F.xxhash64("doc_id").alias("hash"), "x.text", *(f"x.{c}" for c in rest))
    first = stored(first, "labelled")
    sizes = first.select("hash", F.octet_length("text").alias("n")).groupBy("hash").agg(F.sum("n").alias("n")).orderBy("hash")
    fits, total = [], 0
    for row in sizes.collect():  # at most ``most`` rows of two numbers
        if total + row["n"] <= most_bytes:
            total += row["n"]
            fits.append(row["hash"])
    return first if len(fits) == first.count() else first.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in fits], "hash long")), "hash", "left_semi").select(*first.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine, learnt from the labelled documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, values, starts = _features(part)
                ends = pa.array(np.concatenate([starts, [len(at)]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("label"), *lists], ["hash", "label", "at", "x"])

    rows = labelled(_rows(docs), labels, "quality", TRAIN_ROWS, TRAIN_BYTES).select("hash", "text", "n_chars", "label")
    found = rows.mapInArrow(run, "hash long, label int, at array<int>, x array<float>").toArrow().sort_by("hash").combine_chunks()
    if not found.num_rows:
        return train(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0))
    lists = found.column("at").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    values = found.column("x").combine_chunks().flatten().to_numpy().astype(np.float64)
    return train(lists.flatten().to_numpy().astype(np.int64), values, np.cumsum(sizes) - sizes, found.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), and predicted (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                z = logits(shared.value, *_features(part))[0]
                p = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), p], ["doc_id", "score"])

    rows = _rows(docs)
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

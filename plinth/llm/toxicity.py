"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and of itself, all hashed; its
embedding is the mean of theirs, and a window of WINDOW words is the mean of its
words. A linear softmax tells toxic from other windows. Embeddings and softmax
are trained jointly in numpy, so a misspelling never seen before shares the
n-grams of what it resembles. Labels belong to documents, so a document's logit
is a soft maximum over all its windows: gradients reach the windows that speak
for the label. All of the text is used, in training and in scoring.

The softmax is linear in the mean, so a word contributes one number: scoring
looks every distinct word up once in a task and takes moving averages.

The model learns from at most TRAIN_ROWS labelled documents with TRAIN_BYTES of
text together, those whose hashed ids are least, none of them held out. A fifth of
them only chooses the epoch to stop at and calibrates the scores. Labels, language,
source and id are never inputs of a score.

Defined results: null or empty text scores as a window of no words; a word said
many times in a row counts once, so a text of one repeated word scores as that
word; a very long text is scored whole, and learnt from only where it fits into
TRAIN_BYTES; repeated rows give a result each, and of those of one labelled id the
one of the least text hash teaches; a doc_id of any type that labels share, null
too, stays as it is, null is not held out; an empty table gives an empty result;
several labels of a document count as the least; without both labels the score is
the smoothed share of toxic documents. Other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import held_out, slices, text_of
from plinth.llm.quality_fm import labelled

#: Labelled documents that the model learns from at most, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 6000, 24 << 20
BITS, DIMENSIONS, SHORTEST, LONGEST, PRIME = 17, 8, 3, 5, 1_000_003
BUCKETS = 1 << BITS
#: Words of a window and from one window to the next; how much a document leans to its most toxic windows, at first and at last.
WINDOW, STRIDE, FIRST_SHARPNESS, SHARPNESS = 8, 4, 0.05, 4.0
#: Occurrences that a bucket's gradient is taken to have beside its own; damps what is rare.
RARE = 10.0
SHRINK = 0.003
#: Entries of a gradient above this part of the largest are stepped along alike, those below by their size.
EVEN = 1.0
#: Afterwards, rounds of choosing windows and passes over them; of a document that isn't toxic, the windows that look it most and
#: this share of the others are chosen. Step of Adagrad, and what it starts from.
ROUNDS, PASSES, HARDEST, EASY, BATCH, STEP, PRIOR, SOFTMAX_STEP = 3, 4, 4, 0.02, 256, 0.3, 3e-3, 2e-3
EPOCHS, RATE, SEED = 60, 0.3, 5
THRESHOLD, TOXIC_WEIGHT = 0.5, 1.5
EDGES = ".,;:!?\"'()[]{}*#$%&|<>"
#: Distinct words that a task remembers; beyond, it starts anew. Words that training hashes in one step.
REMEMBERED, PART = 300_000, 50_000


class Model(NamedTuple):
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray


class Subwords(NamedTuple):
    """The buckets of a list of words: of the words themselves, and for each length of the n-gram that starts at each character."""

    starts: np.ndarray
    whole: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    sizes: np.ndarray


def subwords(words: list[str]) -> Subwords:
    """Hashes words, without punctuation at their ends, and their n-grams, edges marked; all words at once."""
    marked = [f"<{w.strip(EDGES)}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(chars))

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    powers = np.cumprod(np.concatenate([[1], np.full(max(int(lengths.max(initial=0)) - 1, 0), PRIME)]).astype(np.uint64))
    within = np.arange(len(chars)) - np.repeat(starts, lengths)
    whole = bucket(np.add.reduceat(chars * powers[within], starts) if len(words) else np.empty(0, np.uint64))
    grams, sizes = [], np.ones(len(words), np.int64)
    for n in range(SHORTEST, LONGEST + 1):
        h = np.full(len(chars), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(PRIME) + np.concatenate([chars[k:], np.zeros(min(k, len(chars)), np.uint64)])
        grams.append((bucket(h), left >= n))
        sizes += np.maximum(lengths - n + 1, 0)
    return Subwords(starts, whole, grams, sizes)


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text; a word said many times in a row counts once."""
    words = text.lower().split()
    return [w for w, _ in groupby(words)] if any(map(eq, words, words[1:])) else words


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the windows that cover n words; one empty window for none."""
    first = np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, np.int64)
    first = np.minimum(first, max(n - WINDOW, 0))
    return first, np.minimum(first + WINDOW, n)


def _pooled(z: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """For each run of z a mean that leans to its largest entries the more, the sharper; and each entry's share of the gradient."""
    top = np.maximum.reduceat(z, starts)
    weight = np.exp(sharpness * (z - np.repeat(top, sizes)))
    total = np.add.reduceat(weight, starts)
    return top + np.log(total / sizes) / sharpness, weight / np.repeat(total, sizes)


def _calibrated(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic regression of the labels on z, by Newton's method with a slight pull to zero.

    A toxic document counts TOXIC_WEIGHT times.
    """
    weight = np.where(labels == 1, TOXIC_WEIGHT, 1.0)
    scale = max(1e-9, float(np.abs(z).max()))
    x, theta = np.stack([z / scale, np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + 1e-3 * theta
        theta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return float(theta[0] / scale), float(theta[1])


class _Corpus:
    """The training documents as numbers: words by position, n-grams by word, windows by document."""

    def __init__(self, texts: Iterable[str]) -> None:
        known: dict[str, int] = {}
        ids, firsts, ends, counts, offset = array("i"), [], [], [], 0
        for text in texts:
            words = words_of(text)
            ids.extend(known.setdefault(w, len(known)) for w in words)
            first, end = windows(len(words))
            firsts.append(first + offset)
            ends.append(end + offset)
            counts.append(len(first))
            offset += len(words)
        words, grams, sizes = list(known), [], []
        for k in range(0, max(len(words), 1), PART):
            found = subwords(words[k : k + PART])
            word = np.repeat(np.arange(len(found.sizes)), np.diff(np.append(found.starts, len(found.grams[0][0]))))
            of_word = np.concatenate([np.arange(len(found.sizes)), *(word[valid] for _, valid in found.grams)])
            own = np.concatenate([found.whole, *(b[valid] for b, valid in found.grams)])
            grams.append(own[np.argsort(of_word, kind="stable")].astype(np.int32))
            sizes.append(found.sizes)
        self.ids, self.gram, self.sizes = np.frombuffer(ids, np.int32), np.concatenate(grams), np.concatenate(sizes)
        self.gram_word, self.gram_start = np.repeat(np.arange(len(known), dtype=np.int32), self.sizes), np.cumsum(self.sizes) - self.sizes
        self.first, self.end, self.counts = np.concatenate(firsts), np.concatenate(ends), np.asarray(counts)
        self.starts, self.length = np.cumsum(self.counts) - self.counts, np.maximum(self.end - self.first, 1)

    def means(self, of_gram: np.ndarray) -> np.ndarray:
        """What every window has on average, where a gram has ``of_gram``."""
        word = np.add.reduceat(of_gram[self.gram], self.gram_start) / self.sizes if len(self.sizes) else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(word[self.ids])])
        return (sums[self.end] - sums[self.first]) / self.length

    def pulls(self, of_window: np.ndarray) -> np.ndarray:
        """The transpose of ``means``: what every gram gets from its windows."""
        n = len(self.ids) + 1
        edges = np.bincount(self.first, of_window / self.length, n) - np.bincount(self.end, of_window / self.length, n)
        word = np.bincount(self.ids, np.cumsum(edges)[:-1], len(self.sizes))
        return np.bincount(self.gram, (word / self.sizes)[self.gram_word], BUCKETS)


def _find(corpus: _Corpus, labels: np.ndarray, held: np.ndarray, rng: np.random.Generator) -> Model:
    """Finds what tells toxic documents: full-batch descent on the logistic loss of pooled windows.

    Pooling goes from a plain mean over a document to one that leans to its most toxic windows. A step's entries are evened out
    above a part of the largest, and damped for rare buckets. The held documents only tell which epoch is best.
    """
    state = [rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, 2)), np.array([0.5, -0.5])]
    moments = [np.zeros_like(x) for x in state]
    damping = 1 / np.sqrt(np.bincount(corpus.gram, (np.bincount(corpus.ids, minlength=len(corpus.sizes)) / corpus.sizes)[corpus.gram_word], BUCKETS) + RARE)
    weight = np.where(labels == 1, max(1.0, min(4.0, (labels == 0).sum() / (labels == 1).sum())), 1.0)
    weight /= weight[~held].sum()
    best, chosen = np.inf, Model(*state)
    for step in range(1, EPOCHS + 1):
        embeddings, softmax, bias = state
        toward = softmax[:, 1] - softmax[:, 0]
        late = min(1.0, 2 * step / EPOCHS)
        logit, share = _pooled(corpus.means(embeddings @ toward) + bias[1] - bias[0], corpus.starts, corpus.counts, SHARPNESS**late * FIRST_SHARPNESS ** (1 - late))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -weight * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))
        judged = loss[held if held.any() else ~held].mean()
        if step > EPOCHS // 2 and judged < best:
            best, chosen = judged, Model(*(x.copy() for x in state))
        dz = np.repeat(np.where(held, 0.0, weight * (p - labels)), corpus.counts) * share
        pull = corpus.pulls(dz)
        d_toward = pull @ embeddings
        gradients = [np.outer(damping * pull, toward), np.stack([-d_toward, d_toward], axis=1), np.array([-dz.sum(), dz.sum()])]
        fade = RATE * (1 - (step - 1) / EPOCHS)
        for x, g, m in zip(state, gradients, moments, strict=True):
            m += 0.2 * (g - m)
            size = np.abs(m)
            x -= SHRINK * x + fade * m / (size + EVEN * size.max() + 1e-12)
    return chosen


def _refine(corpus: _Corpus, labels: np.ndarray, held: np.ndarray, model: Model, rng: np.random.Generator) -> Model:
    """Learns from single windows: in toxic documents those that look toxic, in others the hardest and a share of the rest.

    The held documents take no part but in the last calibration, as what was learnt from scores higher than what is new.
    """
    e, softmax = model.embeddings.copy(), model.softmax.copy()
    seen, owner = np.full(BUCKETS, PRIOR), np.repeat(np.arange(len(labels)), corpus.counts)
    for _ in range(ROUNDS):
        z = corpus.means(e @ (softmax[:, 1] - softmax[:, 0]))
        slope, base = _calibrated(np.maximum.reduceat(z, corpus.starts), labels)
        softmax *= slope
        z = z * slope + base
        order, rank = np.lexsort((-z, owner)), np.empty(len(z), np.int64)
        rank[order] = np.arange(len(z)) - np.repeat(corpus.starts, corpus.counts)
        toxic = (labels[owner] == 1) & ((rank == 0) | (z > 0))
        picked = np.nonzero(~held[owner] & (toxic | (labels[owner] == 0) & ((rank < HARDEST) | (rng.random(len(z)) < EASY))))[0]
        for _ in range(PASSES):
            rng.shuffle(picked)
            for k in range(0, len(picked), BATCH):
                w = picked[k : k + BATCH]
                n = corpus.end[w] - corpus.first[w]
                at = corpus.ids[np.repeat(corpus.first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                m = corpus.sizes[at]
                g = corpus.gram[np.repeat(corpus.gram_start[at] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                row = np.repeat(np.arange(len(w)), n)
                share, row = np.repeat(1 / (m * corpus.length[w][row]), m), np.repeat(row, m)
                toward = softmax[:, 1] - softmax[:, 0]
                z = np.bincount(row, share * (e @ toward)[g], len(w)) + base
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[w]
                pull = np.bincount(g, share * error[row], BUCKETS)
                seen += pull**2
                step = STEP * pull / np.sqrt(seen)
                turn = step @ e
                e -= np.outer(step, toward)
                turn *= SOFTMAX_STEP / max(1e-9, float(np.abs(turn).max()))
                softmax += np.stack([turn, -turn], axis=1)
                base -= 0.05 * STEP * float(error.mean())
    judged = held if held.any() else ~held
    z = np.maximum.reduceat(corpus.means(e @ (softmax[:, 1] - softmax[:, 0])), corpus.starts)
    slope, base = _calibrated(z[judged], labels[judged])
    return Model(e.astype(np.float32), (softmax * slope).astype(np.float32), np.array([-base / 2, base / 2]))


def train(texts: Iterable[str], labels: np.ndarray) -> Model:
    """The model of labelled texts; the same input gives the same model. A document's logit is that of its most toxic window."""
    if not 0 < labels.sum() < len(labels):
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), np.array([0.0, np.log(share / (1 - share))]))
    rng = np.random.default_rng(SEED)
    corpus = _Corpus(texts)
    held = np.arange(len(labels)) % 5 == 4
    if not 0 < labels[~held].sum() < (~held).sum() or not 0 < labels[held].sum() < held.sum():
        held[:] = False
    return _refine(corpus, labels, held, _find(corpus, labels, held, rng), rng)


class Scorer:
    """Scores texts with a model; remembers what words contribute."""

    def __init__(self, model: Model) -> None:
        self._grams = (model.embeddings @ (model.softmax[:, 1] - model.softmax[:, 0])).astype(np.float64)
        self._bias = float(model.bias[1] - model.bias[0])
        self._known: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """What words contribute: each the mean of its buckets."""
        found = subwords(words)
        sums = self._grams[found.whole]
        for b, valid in found.grams:
            sums = sums + (np.add.reduceat(self._grams[b] * valid, found.starts) if words else 0)
        return sums / found.sizes

    def logits(self, texts: list[str]) -> np.ndarray:
        """For each text the logit of its most toxic window."""
        split = [words_of(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = list(set().union(*split) - self._known.keys())
        self._known.update(zip(new, self.words(new).tolist(), strict=True))
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self._known.__getitem__, words), np.float64, len(words)))])
            first, end = windows(len(words))
            out[i] = ((sums[end] - sums[first]) / np.maximum(end - first, 1)).max() + self._bias
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, learnt from the labelled documents that are not held out."""
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    found = labelled(rows, labels, "toxic", TRAIN_ROWS, TRAIN_BYTES).select("doc_id", "text", "label").toArrow().combine_chunks()
    found = found.append_column("hash", pa.array([crc32(str(i).encode()) for i in found.column("doc_id").to_pylist()], pa.int64()))
    found = found.sort_by([("hash", "ascending"), ("doc_id", "ascending")])
    return train((t.as_py() for t in found.column("text")), np.asarray(found.column("label").to_pylist(), np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: toxic is likelier), and predicted (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch):
                z = scorer.logits(part.column("text").to_pylist())
                p = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), p], ["doc_id", "score"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

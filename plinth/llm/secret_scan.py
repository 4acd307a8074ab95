"""Secret scan: rules propose, a character convolutional network judges every candidate in its context.

Candidates are the matches of the base rules, values after other names of keys,
and every other run of RUN or more token characters that mixes letters with digits
or cases. A network in numpy reads a candidate's characters with LEFT characters
before and RIGHT after it: embedding, convolution, maximum and mean over positions,
one hidden layer. It reads VALUE characters at a time; a longer candidate is read
in windows STRIDE apart, the last one at its end, and has the highest of their
scores.

All labelled findings teach it. Secrets are the matches of the rules, and secrets of
known formats, made up and planted in the contexts of the corpus' words. Others are
long words (one of each document), runs that stand in three or more different
contexts, and names, numbers and paths made of the corpus' words; every long word's
context takes a made-up secret or a made-up name. A run that stands in fewer contexts
teaches nothing. Findings are dealt by a hash into groups of some GROUP; each group's
task goes on from the same network, and the mean of what they learned is the next
one, ROUNDS times (a single group learns alone). Every secret is also shown in the context of another finding, and
every other finding in that of a secret of its group, so that the network has to judge the
candidate itself and key words can't decide. A quarter of the findings is kept back:
on all of these the scores are calibrated (Platt), and the threshold is even odds, or the
highest below that still finds RECALL of the secrets. Candidates from the threshold on are added to
the spans of the rules (kind cnn), which always stay; every span has its score.

Offsets are code points, ends exclusive.

Defined results: null or empty text has no spans; a very long text is scanned whole,
in time linear in its length; repeated rows give a result each; a doc_id of any
type, null too, stays as it is; an empty table gives an empty result; without a
single word to learn from nothing is added and scores are null. Other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, stored, text_of

ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KEYS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
#: Other names that values stand after, and their values.
NAMES = ("key", "pwd", "pass", "auth", "bearer", "credential", "private")
#: Blanks are taken once and not given back, so that a long row of them is read once.
NAMED = rf"(?:{'|'.join(NAMES)})[A-Za-z_-]{{0,16}}[\"']?(?:\x20*+[:=]\x20*+|\x20++)[\"']?([A-Za-z0-9+/_.=!@#$%^&*~-]{{8,}})"
RUN, LEFT, VALUE, RIGHT = 12, 24, 64, 8
#: Characters between the windows of a candidate longer than VALUE: any VALUE - STRIDE + 1 in a row are whole in one.
STRIDE = 32
RUNS = rf"[A-Za-z0-9+/_-]{{{RUN},}}={{0,2}}"
_DIGIT, _LETTER, _BOTH_CASES = (re.compile(x).search for x in ("[0-9]", "[A-Za-z]", "[a-z][A-Z]"))
LENGTH = LEFT + VALUE + RIGHT
#: Findings of a group; means of the groups' networks; contexts that make a run a name; part kept back for calibration, and secrets to be
#: found there; logits are counted in bins of this width for both.
GROUP, ROUNDS, CONTEXTS, KEPT_BACK, RECALL, BIN = 12_000, 2, 3, 4, 0.98, 1 / 256
SYMBOLS, EMBEDDED, WIDTH, FILTERS, HIDDEN = 98, 12, 5, 24, 16
#: Passes of a single group, and its steps at least.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 800, 64, 3e-3, 3
FOUND = "array<struct<kind:string,start:int,end:int,window:string,whole:string>>"
# Public forms of secrets, as prefix, alphabet, least and largest number of characters after the prefix.
_ALNUM = string.ascii_letters + string.digits
FORMATS = (
    ("", "0123456789abcdef", 20, 64),
    ("", "0123456789ABCDEF", 20, 64),
    ("", _ALNUM, 12, 48),
    ("", _ALNUM + "+/", 20, 64),
    ("", _ALNUM + "-_", 20, 64),
    ("", string.ascii_uppercase + string.digits, 16, 32),
    ("", string.ascii_lowercase + string.digits, 16, 40),
    ("ghp_", _ALNUM, 36, 36),
    ("glpat-", _ALNUM, 20, 20),
    ("npm_", _ALNUM, 36, 36),
    ("sk_live_", _ALNUM, 24, 32),
    ("xoxb-", string.digits + "-" + _ALNUM, 40, 52),
    ("AIza", _ALNUM + "-_", 35, 35),
    ("ASIA", string.ascii_uppercase + string.digits, 16, 16),
    ("eyJ", _ALNUM + "-_", 30, 61),
)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _apart(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of spans, which come in order, that overlap none of ``taken``, which is in order and disjoint; one pass over both."""
    k = 0
    for s, e in spans:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            yield s, e


def mixes(run: str) -> bool:
    """Whether a run has both digits and letters, or a capital after a small letter; each character is looked at three times at most."""
    return bool(_DIGIT(run) and _LETTER(run) or _BOTH_CASES(run))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all candidates: base rules, named values, further runs, and at most one long word as a counterexample."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in re.finditer(ACCESS, text)]
    found += [("hex", *m.span()) for m in re.finditer(HEX, text)]
    taken = _united([x[1:] for x in found])
    if any(k in low for k in NAMES):
        values = (m.span(1) for m in re.finditer(NAMED, text, re.ASCII | re.IGNORECASE) if mixes(m[1]))
        named = list(_apart(values, taken))
        found += [("run", *x) for x in named]
        taken = _united(taken + named)
    words = []
    for s, e in _apart((m.span() for m in re.finditer(RUNS, text)), taken):
        run = text[s:e]
        if mixes(run):
            found.append(("run", s, e))
        elif run.isalpha():
            words.append((zlib.crc32(run.encode()), s, e))
    return found + ([("word", *min(words)[1:])] if words else [])


def window(text: str, start: int, end: int) -> str:
    """A candidate's first VALUE characters between its context, in fixed places; blanks fill up."""
    return text[max(0, start - LEFT) : start].rjust(LEFT) + text[start : min(end, start + VALUE)].ljust(VALUE) + text[end : end + RIGHT].ljust(RIGHT)


def windows_of(first: str, whole: str | None) -> Iterator[str]:
    """What the network reads of a candidate: its first window and, where it is longer, those of its other characters in the same context."""
    yield first
    if whole is not None:
        last = len(whole) - VALUE
        for at in (*range(STRIDE, last, STRIDE), last):
            yield first[:LEFT] + whole[at : at + VALUE] + first[LEFT + VALUE :]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row of docs: its candidates with their first window, and those longer than VALUE whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("window", pa.string()), ("whole", pa.string())]))
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    each = candidates(text)
                    found.append([{"kind": k, "start": s, "end": e, "window": window(text, s, e), "whole": text[s:e] if e - s > VALUE and k != "word" else None} for k, s, e in each])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found {FOUND}")


def made_up(words: list[str], label: int, rng: np.random.Generator) -> str:
    """A secret of a known format (label 1), or a name, number or path made of words (0)."""

    def drawn(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def word() -> str:
        return words[rng.integers(0, len(words))].lower()[: rng.integers(3, 11)]

    def number(n: int) -> str:
        return drawn(string.digits, n)

    def secret() -> str:
        prefix, alphabet, least, most = FORMATS[rng.integers(0, len(FORMATS))]
        return prefix + drawn(alphabet, int(rng.integers(least, most + 1)))

    names = (
        lambda: f"{word()}_{word()}_{number(rng.integers(1, 5))}",
        lambda: f"{word()}{word().title()}{word().title()}{number(rng.integers(1, 4))}",
        lambda: f"{word().title()}{word().title()}{word().title()}",
        lambda: f"{word()}-{word()}-20{number(2)}-{number(2)}-{number(2)}",
        lambda: f"/{word()}/{word()}/{word()}{number(rng.integers(1, 5))}/{word()}",
        lambda: f"{word()}{word()}{number(rng.integers(1, 7))}",
        lambda: f"20{number(6)}T{number(6)}Z",
        lambda: f"v{number(1)}-{number(1)}-{number(2)}-{word()}-{word()}",
        lambda: f"{word().upper()[:3]}-{number(rng.integers(6, 11))}",
        lambda: f"{word().upper()}_{word().upper()}_{number(1)}",
        lambda: f"{number(rng.integers(7, 12))}-{word()}",
    )
    return secret() if label else names[rng.integers(0, len(names))]()


def planted(window: str, value: str) -> str:
    """A finding's window with another value in its place."""
    return window[:LEFT] + value[:VALUE].ljust(VALUE) + window[LEFT + VALUE :]


class Network(NamedTuple):
    embedding: np.ndarray
    convolution: np.ndarray
    convolution_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


class Judge(NamedTuple):
    network: Network
    slope: float
    base: float
    threshold: float


def symbols(windows: list[str]) -> np.ndarray:
    """Character numbers: printable ASCII, other white space, everything else."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), LENGTH).astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw < 32, 96, 97))


def forward(net: Network, x: np.ndarray) -> tuple:
    """The logit of every row of character numbers, and what the gradient needs."""
    columns = np.lib.stride_tricks.sliding_window_view(net.embedding[x], WIDTH, axis=1).transpose(0, 1, 3, 2)
    columns = columns.reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBEDDED)
    conv = np.maximum(columns @ net.convolution + net.convolution_bias, 0)
    top = conv.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0], conv.mean(axis=1)], axis=1)
    hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    return hidden @ net.out + net.out_bias[0], columns, conv, top, pooled, hidden


def backward(net: Network, x: np.ndarray, error: np.ndarray, state: tuple) -> Network:
    """The gradient of the summed loss whose derivative by the logits is ``error``."""
    _, columns, conv, top, pooled, hidden = state
    d_hidden = np.outer(error, net.out) * (hidden > 0)
    d_pooled = d_hidden @ net.hidden.T
    d_conv = np.repeat(d_pooled[:, None, FILTERS:] / conv.shape[1], conv.shape[1], axis=1)
    rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
    d_conv[rows, top, filters] += d_pooled[:, :FILTERS]
    d_conv *= conv > 0
    d_columns = (d_conv @ net.convolution.T).reshape(len(x), conv.shape[1], WIDTH, EMBEDDED)
    d_seen = np.zeros((*x.shape, EMBEDDED), error.dtype)
    for k in range(WIDTH):
        d_seen[:, k : k + conv.shape[1]] += d_columns[:, :, k]
    one = np.zeros((x.size, SYMBOLS), np.float32)
    one[np.arange(x.size), x.ravel()] = 1
    flat = columns.reshape(-1, WIDTH * EMBEDDED)
    return Network(
        one.T @ d_seen.reshape(-1, EMBEDDED), flat.T @ d_conv.reshape(-1, FILTERS), d_conv.sum((0, 1)), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ error, np.array([error.sum()]),
    )


def _platt(z: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and base that make the scores probabilities, by Newton's method on smoothed labels, each so often as it counts."""
    n = counts[labels == 1].sum()
    y = np.where(labels == 1, (n + 1) / (n + 2), 1 / (counts.sum() - n + 2))
    x, start = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(theta: np.ndarray) -> float:
        at = x @ theta
        return float(counts @ (np.logaddexp(0, at) - y * at) + 5e-3 * ((theta - start) ** 2).sum())

    theta = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (counts * (p - y)) + 1e-2 * (theta - start))
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
    return float(theta[0]), float(theta[1])


def kept_back(labels: np.ndarray) -> np.ndarray:
    """True for the findings that the network doesn't learn from; none where they or the others would lack a label."""
    back = np.arange(len(labels)) % KEPT_BACK == KEPT_BACK - 1
    return back if 0 < labels[back].sum() < back.sum() and 0 < labels[~back].sum() < (~back).sum() else np.zeros(len(labels), bool)


def swapped(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Every finding in the context of one with the other label; as it is where there is none."""
    yes, no = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(yes) or not len(no):
        return x
    other = x[np.where(y == 1, rng.choice(no, len(y)), rng.choice(yes, len(y)))]
    return np.concatenate([other[:, :LEFT], x[:, LEFT : LEFT + VALUE], other[:, LEFT + VALUE :]], axis=1)


def first_network() -> Network:
    rng = np.random.default_rng(SEED)

    def scaled(*shape: int) -> np.ndarray:
        return rng.normal(0, np.sqrt(2 / shape[0]), shape)

    zeros = np.zeros
    net = rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)), scaled(WIDTH * EMBEDDED, FILTERS), zeros(FILTERS), scaled(2 * FILTERS, HIDDEN), zeros(HIDDEN), scaled(HIDDEN), zeros(1)
    return Network(*(p.astype(np.float32) for p in net))


def learn(net: Network, windows: list[str], labels: np.ndarray, epochs: int, seed: int = SEED) -> Network:
    """The network after so many passes over the findings, each also in another's context. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    x, y = symbols(windows), labels.astype(np.float64)
    x_all, y_all = np.concatenate([x, swapped(x, y, rng)]), np.concatenate([y, y])
    net = Network(*(p.copy() for p in net))
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(y_all))
        for k in range(0, len(order), BATCH):
            rows, step = order[k : k + BATCH], step + 1
            state = forward(net, x_all[rows])
            error = ((1 / (1 + np.exp(-np.clip(state[0], -30, 30))) - y_all[rows]) / len(rows)).astype(np.float32)
            for p, g, m, v in zip(net, backward(net, x_all[rows], error, state), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def logits(net: Network, windows: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of findings, each in its own context and in another's, in whole bins, and their labels."""
    x = symbols(windows)
    x = np.concatenate([x, swapped(x, labels, np.random.default_rng(SEED))])
    z = np.concatenate([forward(net, part)[0] for part in np.array_split(x, -(-len(x) // 256))])
    return np.rint(z / BIN).astype(np.int64), np.concatenate([labels, labels])


def calibrated(net: Network, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> Judge:
    """The judge that the logits of the kept-back findings, counted by bin and label, make of a network."""
    order = np.lexsort((labels, bins))
    z, labels, counts = bins[order] * BIN, labels[order], counts[order]
    slope, base = _platt(z, labels, counts)
    p, n = 1 / (1 + np.exp(-np.clip(slope * z + base, -30, 30))), np.where(labels == 1, counts, 0)
    by_score = np.argsort(p, kind="stable")
    place = int((1 - RECALL) * n.sum())
    return Judge(net, slope, base, min(0.5, float(p[by_score][np.searchsorted(np.cumsum(n[by_score]), place, "right")])))


def train(windows: list[str], labels: np.ndarray) -> Judge | None:
    """The calibrated network of a single group, or None without findings of both labels. The same input gives the same network."""
    if not 0 < labels.sum() < len(labels):
        return None
    back = kept_back(labels)
    own, judged = [w for w, b in zip(windows, back, strict=True) if not b], back if back.any() else ~back
    net = learn(first_network(), own, labels[~back], max(EPOCHS, -(-STEPS * BATCH // (2 * len(own)))))
    z, y = logits(net, [w for w, b in zip(windows, judged, strict=True) if b], labels[judged])
    return calibrated(net, z, y, np.ones(len(z)))


def scores(judge: Judge, windows: Iterable[str]) -> np.ndarray:
    """Calibrated probabilities that the windows hold secrets."""
    parts = [forward(judge.network, symbols(list(part)))[0] for part in batched(windows, 256)]
    return 1 / (1 + np.exp(-np.clip(judge.slope * np.concatenate([*parts, np.empty(0)]) + judge.base, -30, 30)))


def highest(judge: Judge, found: list[dict]) -> list[float]:
    """The highest score of each candidate's windows."""
    if not found:
        return []
    counts = []

    def read() -> Iterator[str]:
        for f in found:
            n = 0
            for w in windows_of(f["window"], f["whole"]):
                n += 1
                yield w
            counts.append(n)

    p = scores(judge, read())
    return np.maximum.reduceat(p, np.cumsum([0, *counts[:-1]])).tolist()


def labelled(scanned: DataFrame) -> DataFrame:
    """(window, label, hash): every finding of a scan that teaches, once, and what is made up for the contexts of its words."""
    each = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.window").distinct()
    value = F.substring("window", LEFT + 1, VALUE)
    names = each.where("kind = 'run'").groupBy(value.alias("v")).agg(F.count_distinct(F.substring("window", 1, LEFT)).alias("n"), F.min("window").alias("window"))
    rows = each.where("kind != 'run'").select("window", F.col("kind").isin(*BASE).cast("int").alias("label"), (F.col("kind") == "word").alias("word"))
    rows = rows.union(names.where(F.col("n") >= CONTEXTS).select("window", F.lit(0), F.lit(False)))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, labels = batch.column("window").to_pylist(), batch.column("label").to_pylist()
            for window, word in zip(batch.column("window").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if word:
                    rng = np.random.default_rng(zlib.crc32(window.encode()))
                    label = int(rng.integers(0, 2))
                    windows.append(planted(window, made_up(re.findall("[A-Za-z]{3,}", window), label, rng)))
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.int32())], ["window", "label"])

    return rows.mapInArrow(more, "window string, label int").withColumn("hash", F.xxhash64("window"))


def _held(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """The windows and labels of a group, in an order of no meaning that is always the same."""
    rows = sorted(zip(table.column("hash").to_pylist(), table.column("window").to_pylist(), table.column("label").to_pylist(), strict=True))
    return [r[1] for r in rows], np.asarray([r[2] for r in rows], np.float64)


def findings(scanned: DataFrame) -> tuple[list[str], np.ndarray]:
    """Windows and labels of all findings of a scan that is small enough for one group."""
    return _held(labelled(scanned).toArrow())


def _lesson(net: Network, number: int) -> Callable[[pa.Table], pa.Table]:
    """What a group makes of a network in a round: its weights, in a row."""

    def taught(table: pa.Table) -> pa.Table:
        found = learn(net, *_held(table), 1, SEED + ROUNDS * table.column("group")[0].as_py() + number)
        return pa.table({"weights": pa.array([np.concatenate([p.ravel() for p in found]).astype(np.float64)], pa.list_(pa.float64()))})

    return taught


def fit(scanned: DataFrame) -> Judge | None:
    """Learns from all findings of a scan."""
    rows = stored(labelled(scanned), "findings")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n = -(-sum(sizes.values()) // GROUP)
    if n == 1:
        return train(*_held(rows.toArrow()))  # up to GROUP windows
    back = F.pmod(F.shiftright("hash", 32), F.lit(KEPT_BACK)) == KEPT_BACK - 1
    rows = rows.withColumns({"back": back, "group": F.pmod("hash", F.lit(n)).cast("int")})
    own, kept = rows.where("not back").drop("back"), rows.where("back").drop("back")
    net = first_network()
    shapes = [p.shape for p in net]
    for number in range(ROUNDS):
        each = own.groupBy("group").applyInArrow(_lesson(net, number), "weights array<double>").select(F.posexplode("weights").alias("i", "w"))
        mean = each.groupBy("i").agg(F.avg(F.col("w").cast("decimal(28,18)")).cast("double").alias("w")).orderBy("i").toArrow()  # decimals: the same sum in any order
        ends = np.cumsum([np.prod(s) for s in shapes])[:-1]
        net = Network(*(p.reshape(s) for p, s in zip(np.split(np.asarray(mean.column("w")).astype(np.float32), ends), shapes, strict=True)))

    def counted(table: pa.Table) -> pa.Table:
        z, y = logits(net, *_held(table))
        found, counts = np.unique(np.stack([z, y.astype(np.int64)]), axis=1, return_counts=True)
        return pa.table({"bin": found[0], "label": found[1], "n": counts.astype(np.int64)})

    bins = kept.groupBy("group").applyInArrow(counted, "bin long, label long, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).toArrow()
    return calibrated(net, *(np.asarray(bins.column(c)) for c in ("bin", "label", "n")))


def judged(scanned: DataFrame, judge: Judge | None) -> DataFrame:
    """(doc_id, spans) for every row of a scan: kind, start, end and score of the base spans and of what else scores from the threshold on (kind cnn)."""
    shared = scanned.sparkSession.sparkContext.broadcast(judge)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[f for f in row if f["kind"] != "word"] for row in batch.column("found").to_pylist()]
            all_found = [f for row in rows for f in row]
            p = iter(highest(shared.value, all_found) if shared.value else [None] * len(all_found))
            out = []
            for row in rows:
                spans = []
                for f in row:
                    score = next(p)
                    if f["kind"] in BASE or score is not None and score >= shared.value.threshold:
                        spans.append({"kind": f["kind"].replace("run", "cnn"), "start": f["start"], "end": f["end"], "score": score})
                out.append(sorted(spans, key=lambda s: (s["start"], [*BASE, "cnn"].index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    schema = f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:double>>"
    return scanned.mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs, by start, then kind."""
    scanned = stored(scan(docs), "candidates")
    return judged(scanned, fit(scanned))


def digests(found: DataFrame) -> DataFrame:
    """The counts of each base kind, the digest of the base spans, all spans, and their scores, from the rows of ``find``."""

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = shown(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.3f", s["score"])), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), scores)

"""SimHash near-duplicate detection by tiled exact comparison.

A document's fingerprint has 64 bits, one vote of every word shingle each. Two
fingerprints link when they differ in at most ``radius`` bits; documents that
links reach form a component.

Equal fingerprints are collapsed first, so copies cost one row. The distinct
ones are dealt into blocks; every pair of blocks is one task, which orders both
sides by the population counts of the four quarters of the fingerprint and compares
tile against tile with numpy exclusive-or and bit counts. Tiles whose population
counts differ by more than the radius are skipped, as the counts bound the
distance from below. A task returns a spanning forest of its links, never all
pairs of a group, and components grow from these forests by star contraction.

Defined results: null or wordless text has fingerprint zero and links like any
other; a very long text is read whole, its shingles a few thousand at a time;
repeated rows stay in ``near_duplicates``, each with its component, and
``deduplicate`` keeps one row of each component; rows with a null doc_id are
members, but give no component id unless all members' ids are null; an empty
table gives an empty result. Other columns of the input, whatever their names and
kinds, are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import packed, slices, stored, text_of

SEED = 42
#: Fingerprints of one block at most; two blocks meet in a task, so this bounds its memory.
BLOCK = 1 << 18
#: Blocks at least, once there are enough fingerprints, so that tasks spread over the cluster.
SPREAD, SPREAD_FROM = 4, 1 << 12
#: Comparisons in one numpy call; the buffers stay in the processor's cache.
TILE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-shingle_words])).tolist()
        ends = (ends[shingle_words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)])
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):
        votes += np.unpackbits(raw[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(raw)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row, and ``fp``, the fingerprint of its whole text as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = [fingerprint(t.as_buffer().to_pybytes(), shingle_words) for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(fp, pa.int64())], [*keep, "fp"])

    rows = docs.select(*keep, text_of(docs).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, or within one: pairs (node, its root)."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(nodes))

    def roots(at: np.ndarray) -> np.ndarray:
        at = parent[at]
        while (up := parent[at]).tobytes() != at.tobytes():
            at = up
        return at

    def tiles(first: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions and values ordered by their counts, the different counts, and where each begins."""
        counts = _counts(nodes[first : first + size])
        order = np.lexsort(counts.T[::-1])
        kinds, starts = np.unique(counts[order], axis=0, return_index=True)
        return order + first, nodes[order + first], kinds, np.append(starts, size)

    def meet(rows: np.ndarray, a: np.ndarray, cols: np.ndarray, b: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(b)))
        for i in range(0, len(a), step):
            for j in range(0, len(b), TILE):
                near = np.bitwise_count(a[i : i + step, None] ^ b[None, j : j + TILE]) <= radius
                if near.any():
                    x, y = np.nonzero(near)
                    x, y = roots(rows[i + x]), roots(cols[j + y])
                    apart = x != y
                    for p in np.unique(x[apart] * len(nodes) + y[apart]).tolist():
                        p, q = divmod(p, len(nodes))
                        while parent[p] != p:
                            p = parent[p]
                        while parent[q] != q:
                            q = parent[q]
                        parent[max(p, q)] = min(p, q)

    order, values, kinds, starts = tiles(0, len(left))
    order2, values2, kinds2, starts2 = (order, values, kinds, starts) if right is None else tiles(len(left), len(right))
    sizes2 = np.diff(starts2)
    for i, kind in enumerate(kinds):
        low, high = np.searchsorted(kinds2[:, 0], [kind[0] - radius, kind[0] + radius + 1]).tolist()
        low = max(low, i) if right is None else low
        near = low + np.nonzero(np.abs(kinds2[low:high] - kind).sum(axis=1) <= radius)[0]
        n = sizes2[near]
        cols = np.repeat(starts2[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = slice(starts[i], starts[i + 1])
        meet(order[rows], values[rows], order2[cols], values2[cols])
    root = roots(np.arange(len(nodes)))
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (``a``, ``b``) between the distinct fingerprints ``fp`` that connect exactly what the links connect."""
    n = distinct.count()
    blocks = max(-(-n // BLOCK), min(SPREAD, -(-n // SPREAD_FROM)), 1)

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        second = table.column("second").to_numpy(zero_copy_only=False)
        own = table.column("pair")[0].as_py()
        a, b = forest(fp[~second], None if own % blocks == own // blocks else fp[second], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = distinct.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("own")).withColumn("other", other)
    pair = F.least("own", "other") * blocks + F.greatest("own", "other")
    dealt = dealt.select("fp", (F.col("own") > F.col("other")).alias("second"), pair.alias("pair"))
    return dealt.groupBy("pair").applyInArrow(run, "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node with an edge but the roots: the root is the least node of its component.

    Large-star and small-star steps alternate until the edges stay the same. Each step
    is an aggregation and a join on the node; adaptive execution splits hot nodes.
    """

    def signed(e: DataFrame) -> tuple:
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(e.agg(F.count("*"), total).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        around = e.union(back) if large else e
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = around.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return out.where("a > b").distinct()

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = stored(edges, "edges")
    seen, now = None, signed(edges)
    while now != seen and now[0]:
        edges = stored(star(star(edges, large=True), large=False), "edges")
        seen, now = now, signed(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(``fp``, ``component_id``) for every distinct fingerprint of the rows (doc_id, fp)."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = contract(links(nodes, radius))
    members = roots.union(roots.select("root", "root").distinct()).withColumnRenamed("node", "fp")
    members = members.join(nodes, "fp")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.select("fp", "root").join(least, "root").select("fp", "component_id")
    whole = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return stored(whole, "classes")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links reach."""
    fps = stored(fingerprints(docs, shingle_words), "rows")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes(fps, radius), "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """One row of docs for each component: that of its least doc_id; among rows of one id, that of the least digest of the whole row.

    The digest is taken of the row as JSON, so columns of any kind are taken; rows alike in every column count as one. Rows are
    shuffled once, by their digest.
    """
    rows = packed(docs, "doc_id", "text").withColumn("own", F.unhex(F.md5(F.to_json("row").cast("binary"))))
    fps = stored(fingerprints(rows, shingle_words, ("doc_id", "own")), "rows")
    chosen = fps.join(classes(fps, radius), "fp").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    chosen = chosen.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("k")).select("k.own").distinct()
    return rows.select("row", "own").join(chosen, "own", "left_semi").dropDuplicates(["own"]).select("row.*")

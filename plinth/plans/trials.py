"""A matrix of trials that can be resumed: results are kept under what made them, checked when they are met again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources import generations


@dataclass
class TrialMatrix:
    """Cells (dictionaries of settings) whose results (rows with a ``key`` that tells them apart) ``run`` makes.

    A cell's folder is named by a digest of its settings and of the inputs' digests, so other settings or inputs are other cells. Its
    result is a generation: files listed with their digests, written whole or not at all. A cell counts as done where all its files are
    there and have the bytes that were written; a missing or damaged one is run again. ``ran`` lists the cells that the last run made.
    What is done is read again, not left out: ``complete`` returns the rows of all cells, whichever run made them.
    """

    spark: SparkSession
    folder: str
    inputs: dict[str, str]
    key: str
    run: Callable[[dict], DataFrame]
    ran: list[dict] = field(default_factory=list)

    def name(self, cell: dict) -> str:
        told = json.dumps({"settings": cell, "inputs": self.inputs}, sort_keys=True)
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def state(self, cell: dict) -> str:
        """missing, damaged or done; one whose manifest can't be read, or doesn't tell the columns of an empty result, is damaged."""
        try:
            found = generations.current(self.name(cell))
        except (OSError, ValueError):
            return "damaged"
        if found is None:
            return "missing"
        if not found["files"] and "schema" not in found:
            return "damaged"
        return "done" if generations.damaged(self.spark, self.name(cell)).isEmpty() else "damaged"

    def complete(self, cells: list[dict]) -> DataFrame:
        """Runs what isn't done, and returns the results of all cells, each row with its cell's settings; empty results, even if all are, have no rows."""
        if not cells:
            raise ValueError("no cells")
        self.ran = [c for c in cells if self.state(c) != "done"]
        parts = []
        for cell in cells:
            if cell in self.ran:
                generations.write(self.run(cell), self.name(cell), self.key)
            parts.append(generations.read(self.spark, self.name(cell)).withColumns({n: F.lit(v) for n, v in cell.items()}))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def digest_of(rows: DataFrame, *columns: str) -> str:
    """A digest of a table whatever the order of its rows: how many they are, and the sums of two hashes of each."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = rows.select(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum("b")).first()
    return hashlib.sha256(repr(tuple(map(str, sums))).encode()).hexdigest()

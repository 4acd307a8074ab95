"""Text functions that Spark has no built-in for; they run on Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType

from plinth.functions.batches import slices

#: Bytes of text whose words are spelled out at once.
TOKEN_SLICE = 1 << 20
_WORD = re.compile(r"\w+")


@pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC form without case."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@arrow_udf(ArrayType(StringType()))
def folded_tokens(text: pa.Array) -> pa.Array:
    """Words of the folded text; of a slice of the batch at a time, so that few words are Python's at once."""

    def words(t: str | None) -> list[str] | None:
        return None if t is None else _WORD.findall(unicodedata.normalize("NFKC", t).casefold())

    kind = pa.list_(pa.string())
    parts = slices(pa.RecordBatch.from_arrays([text], ["text"]), most=TOKEN_SLICE)
    return pa.concat_arrays([pa.array(map(words, part.column("text").to_pylist()), kind) for part in parts] or [pa.array([], kind)])


# What formulas are made readable by, and what makes a line a formula beyond doubt.
_READABLE = (
    ("−", "-"), ("–", "-"), ("π", " pi "), ("λ", " lambda "), ("≤", " <= "), ("≥", " >= "), ("≈", " approx "), ("∈", " element_of "), ("⊆", " subset_of "), ("⟂", " orthogonal_to "),
    ("∫", " integral "), ("∑", " sum "), ("Σ", " sum "), ("√", " sqrt "), ("‖", " || "),
)
_METRIC = re.compile(r"\b(?:RRF|MRR|Recall@|Hit@|nDCG@|Precision@)", re.IGNORECASE)
_SIGNAL = re.compile(r"=|<|>|\^|\|\||\b(?:approx|integral|sum|sqrt|element_of|subset_of|orthogonal_to|norm)\b", re.IGNORECASE)
_CONSTANT = re.compile(r"\d|\b(?:pi|lambda|integral|sum|sqrt)\b", re.IGNORECASE)
_CODE = re.compile(r"\(cid:\d+\)", re.IGNORECASE)


def _readable(line: str) -> str:
    line = unicodedata.normalize("NFKC", _CODE.sub("", line))
    for sign, word in _READABLE:
        line = line.replace(sign, word)
    return " ".join(line.split())


def _sure(line: str) -> bool:
    letters = any(map(str.isalpha, line))
    return 4 <= len(line) <= 240 and letters and bool(_CONSTANT.search(line)) and bool(_METRIC.search(line) or _SIGNAL.search(line))


@pandas_udf(ArrayType(StringType()))
def formula_evidence(lines: pd.Series) -> pd.Series:
    """The first three different formulas of an array of lines, whatever their case, made readable; only those beyond doubt."""

    def chosen(found: list[str] | None) -> list[str]:
        kept: dict[str, str] = {}
        for line in map(_readable, found if found is not None else []):
            if _sure(line) and len(kept) < 3:
                kept.setdefault(line.casefold(), line)
        return list(kept.values())

    return lines.map(chosen)


# Parts of the names of what isn't shown.
_SENSITIVE = re.compile(r"api_?key|secret|token|password|authorization", re.IGNORECASE)


@pandas_udf(StringType())
def without_secrets(text: pd.Series) -> pd.Series:
    """JSON without the keys that name secrets, at any depth; text that is no JSON becomes null."""

    def cut(value: object) -> object:
        if isinstance(value, dict):
            return {k: cut(v) for k, v in value.items() if not _SENSITIVE.search(k)}
        return [cut(v) for v in value] if isinstance(value, list) else value

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(cut(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)

"""Words of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A byte's lower-cased form where it is part of a word (ASCII letters and digits, all bytes beyond ASCII), else 0.
_LOWERED = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _LOWERED[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's bytes begin and the last's end, and the bytes of all rows; texts has no nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return at.astype(np.int64) - int(at[0]), raw


def strings(raw: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The pieces of raw that begin at starts, the last ending where raw ends."""
    ends = np.append(starts, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))


def lowered_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the rows, A-Z lower-cased, and the number of each row's first word, with the number of all words at the end.

    Words are maximal runs of ASCII letters, digits and characters beyond ASCII; every byte of the latter is one beyond ASCII, too.
    """
    at, raw = bytes_of(texts)
    lowered = _LOWERED[raw]
    inside = lowered != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < len(raw)]
    begins[rows] = inside[rows]
    places = np.flatnonzero(begins)
    shift = np.cumsum(~inside, dtype=np.int64)[places]
    return strings(lowered[inside], places - shift), np.searchsorted(places, at)

"""Words of Arrow batches as ``text.tokens`` takes them, cut out of the texts' bytes; none becomes a string of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import WORD

#: What words consist of, by application: Unicode as its Java knows it.
_POINTS: dict[str, np.ndarray] = {}


def word_points(spark: SparkSession) -> np.ndarray:
    """Of each code point, whether words have it, by the expression that ``text.tokens`` uses; asked of Java once for each application."""
    name = spark.sparkContext.applicationId
    if name not in _POINTS:
        point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = spark.range(0x110000).where("id not between 55296 and 57343").where(point.rlike(f"^{WORD}$")).toArrow()
        _POINTS[name] = np.zeros(0x110000, bool)
        _POINTS[name][found.column("id").to_numpy()] = True
    return _POINTS[name]


def words(text: pa.StringArray, points: np.ndarray) -> pa.ListArray:
    """The runs of word characters of each text, which must be lower-cased and not null."""
    _, offsets, values = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = np.frombuffer(values or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if data.max(initial=0) < 0x80:
        inside = points[data]
    else:
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        inside = np.repeat(points[point], 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
    begins = inside & ~np.append(False, inside[:-1]) if len(data) else inside
    first = at[:-1][at[:-1] < len(data)]
    begins[first] = inside[first]  # no word goes on in the next text
    starts = np.flatnonzero(begins)
    kept = data[inside]
    ends = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at), pa.int32()), found)

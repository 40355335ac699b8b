"""Vectors as little-endian 32-bit floats in blobs, read and written without a copy of each value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def floats(blob: Column) -> Column:
    """The floats of a blob; null for a null blob and for one whose length is no multiple of 4; an empty one has none."""

    @F.arrow_udf("array<float>")
    def decode(b: pa.Array) -> pa.Array:
        b = b.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(b), 1).to_numpy()
        fits = sizes % 4 == 0  # not so for a null
        kept = b.filter(pa.array(fits))  # their bytes stand side by side
        ends = kept.buffers()[1]
        start, n = (int(np.frombuffer(ends, np.int64)[kept.offset]) if len(kept) else 0), int(sizes[fits].sum()) // 4
        values = np.frombuffer(kept.buffers()[2], "<f4", n, start) if n else np.empty(0, "<f4")
        at = np.concatenate([[0], np.cumsum(np.where(fits, sizes, 0) // 4)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.float32()), mask=pa.array(~fits))

    return decode(blob)


def blob(vector: Column) -> Column:
    """The blob of a vector; null for a null vector and for one with a null component."""

    @F.arrow_udf("binary")
    def encode(v: pa.Array) -> pa.Array:
        v = v.cast(pa.large_list(pa.float32()))
        ends = v.offsets.to_numpy()
        values = v.values[ends[0] : ends[-1]]
        holes = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values.is_null().to_numpy(zero_copy_only=False), out=holes[1:])
        at = ends - ends[0]
        bad = v.is_null().to_numpy(zero_copy_only=False) | (holes[at[1:]] > holes[at[:-1]])
        data = values.fill_null(0).to_numpy().astype("<f4", copy=False)
        whole = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(data)])
        return pc.if_else(pa.array(bad), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())

    return encode(vector)


def blob_state(blob: Column, width: Column) -> Column:
    """missing, odd (no multiple of 4 bytes), width (another number of floats than stated), not_finite or ok."""
    v = floats(blob)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(blob.isNull(), "missing").when(F.octet_length(blob) % 4 != 0, "odd").when(F.octet_length(blob) / 4 != width, "width").when(~finite, "not_finite").otherwise("ok")

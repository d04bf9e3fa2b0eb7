"""A filter of bounded size over digests that every task may hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

#: Bits at most (32 MB, for 16 million digests): beyond that a fuller filter lets more rows through to the exact join
#: behind it, at most all of them once, never less. Hashes of a digest.
BITS, HASHES = 1 << 28, 4


def size_for(count: int) -> int:
    size = 1 << 10
    while size < min(BITS, 16 * count):
        size *= 2
    return size


def words_of(digests: list[bytes], skip: int = 0) -> np.ndarray:
    """Four 32-bit words of each digest, from byte ``skip`` on."""
    return np.frombuffer(b"".join(x[skip : skip + 4 * HASHES] for x in digests), "<u4").reshape(-1, HASHES)


def holds(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = words & np.uint32(8 * len(bits) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build(digests: DataFrame, count: int, skip: int = 0) -> np.ndarray:
    """Of ``count`` digests, one binary column or two longs: partial bitmaps by word, or-ed in the cluster; size / 64 words come here."""
    size = size_for(count)

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.full(batches):
            own = words_of(b.column(0).to_pylist(), skip) if b.num_columns == 1 else np.stack([c.to_numpy() for c in b.columns], axis=1).view("<u4")
            at = np.unique(own & np.uint32(size - 1))
            mask = np.left_shift(np.uint64(1), (at & np.uint32(63)).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint32(6)).astype(np.int64)), pa.array(mask)], ["word", "mask"])

    got = digests.mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    bits = np.zeros(size // 64, "<i8")
    bits[got["word"].to_numpy()] = got["mask"].to_numpy()
    return bits.view(np.uint8)

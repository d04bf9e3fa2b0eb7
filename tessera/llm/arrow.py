"""What the Arrow-batched operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to Python: bounds a worker's memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def raw(text: Column) -> Column:
    """UTF-8 bytes of a text, none if null."""
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b""))


def text_hash(text: Column) -> Column:
    """With the id it tells a row from others: 64 bits of the text as it is, null being empty."""
    return F.xxhash64(raw(text))


def narrowed(df: DataFrame, **columns: Column) -> DataFrame:
    """Only what an operator reads, by its own names, so that no other column can clash."""
    bound_batches(df.sparkSession)
    return df.select(*[c.alias(n) for n, c in columns.items()])


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def valid(texts: pa.Array) -> pa.Array:
    """The binary texts with what is no UTF-8 in them as U+FFFD."""
    try:
        texts.cast(pa.large_binary()).cast(pa.large_string())
        return texts
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").encode() for x in texts.to_pylist()], texts.type)


def split_words(texts: pa.Array, *, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space of UTF-8 texts, A-Z lower-cased if asked: the distinct ones, the place of
    each word among them, and how many words each text has."""
    texts = texts.cast(pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    found = split.flatten().dictionary_encode()
    distinct = found.dictionary.view(pa.large_binary())
    index = found.indices.to_numpy()
    counts = split.value_lengths().to_numpy().astype(np.int64)
    empty = pc.index(distinct, pa.scalar(b"", pa.large_binary())).as_py()
    if empty >= 0:  # at the ends of a text, or all of it
        real = index != empty
        counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(counts)])])
        index = index[real]
        index = index - (index > empty)
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return distinct, index, counts


def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    distinct, index, counts = split_words(texts)
    return distinct.to_pylist(), index, counts

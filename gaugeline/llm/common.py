"""Helpers shared by the training-data operators: lineage cuts, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import scratch_path

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 128
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the cluster's shared folder and read it back.

    A lost executor costs nothing that was written; the folder comes from spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False) -> DataFrame:
    """``(id long, text)`` of a documents-like table; every other column is left behind, so none can clash."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       (text.cast("binary") if binary else text).alias("text"))


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod`` (NULL for a NULL id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z in lower case (bytes methods know ASCII only)."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(ws: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(size, len(ws))
    n = len(ws) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, mix64(_GOLDEN * np.array([k], np.uint64))[0], np.uint64)
        for j in range(k):
            out = mix64(out * _GOLDEN + h[j:j + n])
    return np.unique(out)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession

"""Token counts with a digest cache: a text is encoded once per tokenizer version, whatever its copies.

The cache is a Parquet table ``(tokenizer, digest, n_tokens)``: the tokenizer's digest is the SHA-256 of its file, a text's
digest that of its normalised content.  Counting joins the texts' digests to the cache, encodes one text of each
missing digest, appends the new counts and joins again.  Normalisation is only what leaves every tokenizer's
count alone (NULL becomes the empty text); a looser one would give counts of another text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, record_batch, slices

_COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Fixed value: the public split pattern of rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def _load(path: str):
    """A function from texts to token counts, for a .model, .json or .tiktoken file."""
    if path.endswith(".model"):
        import sentencepiece
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in own.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(t)) for t in texts]


def counter(path: str):
    """The tokenizer of a file, loaded once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = _load(path)
    return _LOADED[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in slices(batches, 32):
            yield record_batch(_COUNTED, part.column("digest"), count(part.column("text").to_pylist()))
    return run


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row; new counts are appended to the cache at ``cache_path``.

    ``tokenizer_path`` names the same file on the driver and on every executor.  Defined cases: a NULL text counts as the
    empty one; rows that repeat an id, or have none, are counted one by one; copies share one encoding; a missing cache is
    an empty one; repeated cache rows are one; an empty table gives no rows; further columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    # an empty append makes the folder, so that a missing cache reads as an empty one
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cache() -> DataFrame:
        return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
                .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    wanted = rows.select("digest").distinct().join(cache(), "digest", "left_anti")
    misses = (docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
              .join(wanted, "digest", "left_semi"))
    (misses.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path))
    return (rows.join(cache(), "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

"""Embedding near-duplicates: codes by iterative quantisation (ITQ), multi-index Hamming tables, exact rerank.

Method.  Vectors are scaled to length 1.  On a sample of SAMPLE rows, chosen by hash, ITQ learns a rotation of the centred
vectors for which their signs are balanced, faithful bits; ROTATIONS of them, from different starts, give TABLES chunks
of CHUNK_BITS bits.  Every vector is indexed under each of its chunks.  Two vectors are candidates if some chunk
differs in ERRORS = 1 bit at most: one side probes each chunk and its one-bit neighbours.  By the pigeonhole principle every
pair at a Hamming distance under ``TABLES * (ERRORS + 1)`` is a candidate.  A pair is kept only in the first table
that finds it, so nothing is deduplicated by shuffle.  Candidates whose whole codes are close are compared by the
cosine of the original vectors in double precision.

Equal vectors are one row from the start, with a count: a group of copies costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, record_batch, slices
from gaugeline.llm.components import connected_components

TABLES, CHUNK_BITS, ERRORS, SAMPLE, ITERATIONS, SEED = 8, 16, 1, 10_000, 30, 5
#: At cosine 0.9 about 14 % of the bits differ (18 of 128, standard deviation 4); farther codes are not reranked.
MAX_DISTANCE = 42

_CODES = pa.schema([("vid", pa.int64()), ("code", pa.list_(pa.int32()))])


def learn_rotations(sample: np.ndarray, bits: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The mean and a projection of dimension x ``bits``: principal directions, rotated by ITQ, from as many random starts as needed."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    x, rng, d = sample - mean, np.random.default_rng(seed), sample.shape[1]
    _, _, axes = np.linalg.svd(x.T @ x) if len(x) else (0, 0, np.eye(d))
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        v = x @ axes.T
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes.T @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # very large and very small components neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(mean: np.ndarray, projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(CHUNK_BITS)
        for part in slices(batches, 2048):
            bits = (_unit(part.column("v").to_pylist()) - mean) @ projection >= 0
            chunks = bits.reshape(len(bits), TABLES, CHUNK_BITS) @ weight
            yield record_batch(_CODES, part.column("vid"), chunks.tolist())
    return run


def _rerank(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            a, b = (_unit(part.column(c).to_pylist()) for c in ("va", "vb"))
            yield part.select(["a", "b"]).filter(pa.array((a * b).sum(axis=1) >= least))
    return run


def _differ(t: int) -> Column:
    return F.bit_count(F.col("ca")[t].bitwiseXOR(F.col("cb")[t]))


def _masked(masks: Column, t: int) -> Column:
    return F.transform(masks, lambda m: F.col("code")[t].bitwiseXOR(m) + (t << CHUNK_BITS))


def _candidates(codes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, that share a chunk up to one bit and whose whole codes are close."""
    masks = F.array(F.lit(0), *[F.lit(1 << k) for k in range(CHUNK_BITS)])

    def keyed(name: str, masks: Column) -> Column:
        """One row per table and mask: the masked chunk under the table's number."""
        return F.explode(F.concat(*[_masked(masks, t) for t in range(TABLES)])).alias(name)

    index = codes.select(F.col("vid").alias("b"), F.col("code").alias("cb"), keyed("key", F.array(F.lit(0))))
    probe = codes.select(F.col("vid").alias("a"), F.col("code").alias("ca"), keyed("key", masks))
    first = reduce(lambda rest, t: F.when(_differ(t) <= ERRORS, t).otherwise(rest), range(TABLES - 1, -1, -1), F.lit(TABLES))
    whole = reduce(lambda x, y: x + y, [_differ(t) for t in range(TABLES)])
    return (probe.join(index, "key").where("a < b").where(first == F.shiftright("key", CHUNK_BITS))
            .where(whole <= MAX_DISTANCE).select("a", "b"))


def embedding_links(rows: DataFrame, least: float = 0.9, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: distinct usable vectors ``vid, v, n`` with the number of rows each stands for, and the linked
    pairs ``a, b`` of them.  ``rows`` holds ``id, v``."""
    usable = F.when(F.size("v") > 0, F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    good = rows.where(F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull())
    classes = cut(good.groupBy("v").agg(F.min("id").alias("vid"), F.count("*").alias("n")), "vectors")
    some = classes.orderBy(F.xxhash64("vid", F.lit(SEED)), "vid").limit(sample).select("v").collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r[0]), []).append(r[0])
    links = None
    # vectors of different dimension have no cosine: each dimension is searched on its own
    for d in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        own = by_size.get(d)
        mean, projection = learn_rotations(_unit(own) if own else np.zeros((0, d)), TABLES * CHUNK_BITS)
        same = classes.where(F.size("v") == d)
        codes = cut(same.select("vid", "v").mapInArrow(_encode(mean, projection), "vid long, code array<int>"), "codes")
        pairs = cut(_candidates(codes), "candidates")
        full = lambda c: same.select(F.col("vid").alias(c), F.col("v").alias(f"v{c}"))  # noqa: B023, E731
        near = pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "va", "vb").mapInArrow(_rerank(least), "a long, b long")
        links = near if links is None else links.unionAll(near)
    if links is None:
        links = classes.select(F.col("vid").alias("a"), F.col("vid").alias("b")).where("false")
    return classes, cut(links.distinct(), "links")


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                         sample: int = SAMPLE) -> DataFrame:
    """``id, n_links, component_id, kept`` per row: links are other rows at a cosine of ``least`` or more.

    Defined cases: a vector that is NULL, empty, zero or holds a NULL or non-finite component links with nothing; rows with
    equal vectors link with each other; vectors of different dimension don't link; rows that repeat an id are vectors of
    their own that share their component; a row with a NULL id links with nothing (component_id NULL, kept true); an
    empty table gives no rows; further columns are ignored.
    """
    rows = cut(vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")), "rows")
    classes, links = embedding_links(rows, least, sample)
    size = classes.groupBy("vid").agg(F.sum("n").alias("n"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.join(size.withColumnRenamed("vid", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    of_class = (classes.join(found, F.col("vid") == F.col("a"), "left")
                .join(connected_components(links).withColumnRenamed("id", "cid"), F.col("vid") == F.col("cid"), "left")
                .select(F.col("v").alias("cv"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "vid").alias("component_id")))
    named = F.col("id").isNotNull()
    return (rows.join(of_class, (F.col("v") == F.col("cv")) & named, "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(named, F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))

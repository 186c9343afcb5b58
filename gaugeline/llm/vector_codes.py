"""Vector code compression: product codes over integer components, learned and assigned along a trie of distinct parts.

Method.  Each component x becomes floor(4096 * x); a vector is cut into PARTS consecutive parts, and every part position has
a codebook of ENTRIES entries.  Equal parts of a position are one row with a count.  The distinct parts, in lexicographic order,
are the leaves of a trie whose levels are the dimensions.  A depth-first traversal carries the vector of squared
distances to all entries: a child adds its own dimension to what its parent has accumulated, so parts that share a prefix
share that work.  A leaf's smallest accumulated distance names its entry; its components, times its count, go into
that entry's sums.  Subtrees of at most BLOCK leaves are worked off level by level in NumPy, all nodes of a level at once.

The distinct parts are counted once (combined before the shuffle, so a vector that fills a third of the table is one row a
task), sorted inside their partitions and written to the shared folder; each of the rounds is one job over that table whose
tasks return at most PARTS * ENTRIES sums a dimension.  Only codebooks, 16 entries of the vector's length, reach the driver.
All arithmetic is on integers, so the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, record_batch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of a subtree that are worked off level by level.
BLOCK = 8192
#: Integer components stay within +-LARGEST, so no sum of squares overflows; |x| beyond 32,768 is taken as that.
LARGEST = 1 << 27

_SUMS = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def bounds(size: int) -> list[tuple[int, int]]:
    """Start and end of each part of a vector of ``size`` components (equal where PARTS divides it)."""
    return [(size * p // PARTS, size * (p + 1) // PARTS) for p in range(PARTS)]


def _levels(rows: np.ndarray, entries: np.ndarray, depth: int, starts: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Accumulated distances of the leaves below the nodes at ``starts``, which share ``acc`` up to ``depth``."""
    new = np.zeros(len(rows), bool)
    new[starts] = True
    for j in range(depth, rows.shape[1]):
        new[1:] |= rows[1:, j] != rows[:-1, j]
        nodes = np.flatnonzero(new)
        acc = acc[np.searchsorted(starts, nodes, side="right") - 1] + (rows[nodes, j, None] - entries[:, j]) ** 2
        starts = nodes
    return acc


def trie_distances(rows: np.ndarray, entries: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Squared distances (leaves x entries) of distinct, lexicographically sorted ``rows`` to ``entries``."""
    out = np.empty((len(rows), len(entries)), np.int64)
    # nodes in depth-first order: first and last leaf, depth, and the distances accumulated up to there
    stack = [(0, len(rows), 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, acc = stack.pop()
        if hi - lo <= block or depth == rows.shape[1]:
            out[lo:hi] = _levels(rows[lo:hi], entries, depth, np.zeros(1, np.int64), acc[None, :])
            continue
        values = rows[lo:hi, depth]
        starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        below = acc + (values[starts, None] - entries[:, depth]) ** 2
        ends = np.append(starts[1:], hi - lo)
        k = 0
        while k < len(starts):
            # neighbouring children that are small together are one block, a large child is a node of its own
            m = max(k + 1, int(np.searchsorted(ends, starts[k] + block, side="right")))
            if ends[m - 1] - starts[k] <= block:
                at = slice(lo + starts[k], lo + ends[m - 1])
                out[at] = _levels(rows[at], entries, depth + 1, starts[k:m] - starts[k], below[k:m])
            else:
                stack.append((lo + starts[k], lo + ends[k], depth + 1, below[k]))
            k = m
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the place of every row among them."""
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _partial_sums(books: list[np.ndarray]):
    """Weighted sums and counts per entry of the parts of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            where, weight = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
            for p in np.unique(where):
                if not books[p].shape[1]:
                    continue
                own = np.flatnonzero(where == p)
                rows = _matrix(batch.column("part").take(pa.array(own)), books[p].shape[1])
                order = np.lexsort(rows.T[::-1])  # sorted already, but for where two files meet
                rows, n = rows[order], weight[own][order]
                entry = trie_distances(rows, books[p]).argmin(axis=1)
                np.add.at(counts[p], entry, n)
                np.add.at(totals[p], entry, rows * n[:, None])
        found = [(p, e, j, int(counts[p][e]), int(totals[p][e, j])) for p in range(len(books))
                 for e in np.flatnonzero(counts[p]).tolist() for j in range(books[p].shape[1])]
        yield record_batch(_SUMS, *(list(c) for c in zip(*found, strict=True))) if found else record_batch(_SUMS, *[[]] * 5)
    return run


def _encoded(books: list[np.ndarray]):
    """Codes and errors of whole vectors: every part of a batch runs down the trie of the batch's distinct parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(b.shape[1] for b in books)
            v = _matrix(batch.column("v"), size)
            codes, error = np.zeros((len(v), PARTS), np.int64), np.zeros(len(v), np.int64)
            for p, (lo, hi) in enumerate(bounds(size)):
                if hi > lo and len(v):
                    rows, place = _distinct(v[:, lo:hi])
                    far = trie_distances(rows, books[p])
                    codes[:, p], error = far.argmin(axis=1)[place], error + far.min(axis=1)[place]
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             ["vid", "label", "code", "error"])
    return run


def _integers(v: Column) -> Column:
    """The integer components, NULL for a vector that can't be coded."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return F.when(v.isNotNull() & (F.size(v) > 0) & finite, whole)


def learn_codebooks(vectors: DataFrame, size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries x part length) per part position, for ``vectors(vid, v)`` of ``size`` components."""
    first = vectors.orderBy(F.col("vid").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r[0] for r in first], np.int64)
    books = [start[:, lo:hi] for lo, hi in bounds(size)]
    pieces = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("v", lo + 1, hi - lo).alias("part")) for p, (lo, hi) in enumerate(bounds(size))])
    counted = vectors.select(F.explode(pieces).alias("x")).groupBy("x.pos", "x.part").agg(F.count("*").alias("n"))
    parts = cut(counted.sortWithinPartitions("pos", "part"), "parts")
    for _ in range(rounds):
        sums = parts.mapInArrow(_partial_sums(books), "pos int, entry int, dim int, n long, total long")
        books = [b.copy() for b in books]
        for r in sums.groupBy("pos", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.pos][r.entry, r.dim] = r.total // r.n
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` per usable vector.

    Defined cases: a vector that is NULL, empty or holds a NULL or non-finite component is dropped; so is one whose
    dimension differs from that of the first kept vector (smallest id, then smallest vector; NULL ids last).  A
    dimension that PARTS doesn't divide is cut as evenly as can be.  Fewer than ENTRIES vectors give fewer
    entries.  Equal distances go to the lower entry; rows that repeat an id or a vector are rows of their own, in
    codebooks, sums and result; NULL labels are one label; no usable vectors give no rows; further columns are ignored.
    """
    label = F.col(f"`{label_col}`").alias("label")
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vid"), label, _integers(F.col(f"`{vector_col}`").cast("array<double>")).alias("v")).where("v is not null")
    head = kept.orderBy(F.col("vid").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("size")).collect()
    size = head[0].size if head else PARTS
    kept = kept.where(F.size("v") == size)
    books = learn_codebooks(kept.select("vid", "v"), size, rounds) if head else [np.zeros((0, 1), np.int64)] * PARTS
    kind = kept.schema["label"].dataType.simpleString()
    coded = cut(kept.mapInArrow(_encoded(books), f"vid long, label {kind}, code string, error long"), "codes")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("vid").alias("id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")))

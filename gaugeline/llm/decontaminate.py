"""Benchmark decontamination: which documents contain a test item, by MinHash containment and exact confirmation.

Method.  Items and documents are sets of word shingles.  Items are partitioned by set size into bands of powers of
two.  The sketch of an item is its bottom-k MinHash: the k smallest shingle hashes, k being set per band so that an
item of that size cannot miss too many: an item of n shingles that is contained to ``percent`` misses at most
``m = n - ceil(percent * n / 100)`` of them, so of its ``k = m + extra`` sketch hashes at least ``extra`` are in the
document.  Searching a document costs one lookup per shingle in each band's sorted sketch hashes, however many items there
are; a band whose items need more shingles than the document has is skipped.  A short item inside a very long document is
found for sure, with no window or prefix.  Candidates (enough sketch hashes hit) are confirmed by
counting the item's whole shingle set.

The item side is broadcast only while its hashes stay under BROADCAST_HASHES (counted first); beyond that the same
search runs as shuffle joins on the shingle hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, id_text, record_batch, shingle_set, slices, words

#: Shingle hashes of all items that may be broadcast (8 bytes each: 16 MB at most).
BROADCAST_HASHES = 2_000_000
#: Sketch hashes, beyond those an item may miss, that a candidate has to hit, by size band (log2 of the set size).
EXTRA_BY_BAND = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
EXTRA_ABOVE = 3

_ITEMS = pa.schema([("item", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])
_HITS = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
_HITS_SQL = "id long, item long, n_item long, n_shared long"


def missing(n: int, percent: int) -> int:
    """Shingles that an item of n shingles may lack in a document that contains it to ``percent``."""
    return n - -(-percent * n // 100)


def sketch_size(n: int, percent: int) -> int:
    extra = EXTRA_BY_BAND.get(int(n).bit_length() - 1, EXTRA_ABOVE)
    return min(n, missing(n, percent) + extra)


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(words(t), size) for t in part.column("text").to_pylist()]
            yield record_batch(_ITEMS, part.column("id"), [len(h) for h in sets], [h.view(np.int64) for h in sets])
    return run


class _Index:
    """The items' sketch hashes, one sorted table per size band, each hash with the items that have it."""

    def __init__(self, rows: list, percent: int):
        self.items = np.array([r[0] for r in rows], np.int64)
        self.sets = [np.array(r[1], np.int64).view(np.uint64) for r in rows]
        self.need = np.array([-(-percent * len(h) // 100) for h in self.sets], np.int64)
        k = [sketch_size(len(h), percent) for h in self.sets]
        self.hits = np.array([kk - missing(len(h), percent) for kk, h in zip(k, self.sets, strict=True)], np.int64)
        bands = {}
        for i, h in enumerate(self.sets):
            bands.setdefault(len(h).bit_length() - 1, []).append(i)
        self.bands = []
        for _, own in sorted(bands.items()):
            hashes = np.concatenate([self.sets[i][:k[i]] for i in own])
            order = np.argsort(hashes, kind="stable")
            keys, first = np.unique(hashes[order], return_index=True)
            owner = np.repeat(np.array(own, np.int64), [k[i] for i in own])[order]
            self.bands.append((int(self.need[own].min()), keys, np.append(first, len(order)), owner))

    def find(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its set size, shared) of every item contained in a document's shingle set: one lookup per shingle and
        band, then work for the items that were hit alone."""
        found = []
        for least, keys, first, owner in self.bands:
            if len(shingles) < least:
                break   # bands go by size: no item of this one or a later one fits in
            at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
            at = at[keys[at] == shingles]
            if not len(at):
                continue
            size = first[at + 1] - first[at]
            near = owner[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            near, hit = np.unique(near, return_counts=True)
            for i in near[hit >= self.hits[near]]:
                own = self.sets[i]
                place = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                shared = int((shingles[place] == own).sum())
                if shared >= self.need[i]:
                    found.append((int(self.items[i]), len(own), shared))
        return found


def _search(index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                h = shingle_set(words(text), size)
                if len(h):
                    rows += [(i, *hit) for hit in index.value.find(h)]
            yield record_batch(_HITS, *([r[k] for r in rows] for k in range(4)))
    return run


def _shingles(size: int):
    """Shingles of each text; ``key`` tells texts of one id apart (by their sets)."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(words(t), size) for t in part.column("text").to_pylist()]
            ids = np.repeat(np.arange(part.num_rows), [len(h) for h in sets])
            keys = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield record_batch(schema, part.column("id").take(pa.array(ids)), keys[ids],
                               np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
    return run


def _search_by_join(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """The same search with the items too large to broadcast: joins on the shingle hash, sketches first.

    Each pair of texts is counted by itself; several texts may carry one document or item id.
    """
    items = items.withColumn("item_key", F.xxhash64("hashes"))
    item, pair = ["item", "item_key"], ["id", "key", "item", "item_key"]
    size_of, lacks = F.col("n"), F.col("n") - F.ceil(percent * F.col("n") / 100)
    band = F.floor(F.log2(size_of)).cast("int")
    extra = F.coalesce(*[F.when(band == b, F.lit(x)) for b, x in EXTRA_BY_BAND.items()], F.lit(EXTRA_ABOVE))
    k = F.least(size_of, lacks + extra)
    # array_sort orders signed values; the unsigned order of the hashes is their order in the list
    sketch = items.select(*item, (k - lacks).alias("least"), F.explode(F.slice("hashes", 1, k.cast("int"))).alias("h"))
    full = items.select(*item, "n", F.explode("hashes").alias("h"))
    grams = docs.mapInArrow(_shingles(size), "id long, key long, h long").distinct()
    near = (grams.join(sketch, "h").groupBy(*pair, "least").agg(F.count("*").alias("hit"))
            .where("hit >= least").select(*pair))
    texts = grams.join(near.select("id", "key").distinct(), ["id", "key"], "left_semi")
    return (near.join(full, item).join(texts, ["id", "key", "h"]).groupBy(*pair, F.col("n").alias("n_item"))
            .agg(F.count("*").alias("n_shared"))
            .where(100 * F.col("n_shared") >= percent * F.col("n_item")).select("id", "item", "n_item", "n_shared"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80,
                 broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``id, item, n_item, n_shared`` for each document that holds ``percent`` of an item's shingle set, or more.

    Defined cases: a NULL or word-less text or item matches nothing; fewer words than a shingle are one shingle (such
    an item matches only a text that is the same few words); rows that repeat a document id count as one document (the
    most shared shingles of its texts); rows that repeat an item id are separate texts of which the best counts; rows
    with a NULL id, on either side, are left out, as a link could not name them; empty tables give no rows; further
    columns are ignored.
    """
    source = id_text(docs, id_col, text_col, binary=True).where("id is not null")
    known = cut(id_text(items, item_col, item_text_col, binary=True).where("id is not null")
                .mapInArrow(_item_sets(shingle), "item long, n long, hashes array<long>").where("n > 0").distinct(), "items")
    total = known.agg(F.sum("n")).first()[0] or 0
    if total > broadcast_hashes:
        found = _search_by_join(source, known, shingle, percent)
    elif total:
        index = _Index([tuple(r) for r in known.select("item", "hashes").collect()], percent)
        found = source.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index), shingle), _HITS_SQL)
    else:
        return source.select("id", F.col("id").alias("item"), F.lit(0).cast("long").alias("n_item"),
                             F.lit(0).cast("long").alias("n_shared")).where("false")
    return (found.groupBy("id", "item")
            .agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("best"))
            .select("id", "item", "best.n_item", "best.n_shared"))

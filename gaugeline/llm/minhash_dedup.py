"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search, links confirmed on full sets.

Method.  A document is the set of its word shingles.  Documents with the same set form one class (exact
copies cost one row from here on).  A class gets ``CHUNKS * WIDTH`` MinHash values of 12 bits.  The
signature is split into CHUNKS chunks; by the pigeonhole principle two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` positions agree in some chunk up to ERRORS = 1 position.  The allowed error is
enumerated by masking each position in turn: two chunks differ in at most one position exactly if one of their
masked forms is equal, so an equi-join on (chunk, mask, rest) finds every such pair.

Large groups.  A bucket never emits all its pairs.  In each star round every member is compared, by signature, with one
member of its bucket only; pairs that are close make families.  A family's full sets are then compared in blocks of
bounded size: a block pair is one small matrix product over shared shingles, and only a spanning forest of the links it
finds leaves the task.  Pairs of a bucket that lie in different families are at last compared by signature inside the join
and, if close, on full sets, so no candidate is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, id_text, mix64, record_batch, shingle_set, slices, words
from gaugeline.llm.components import connected_components

CHUNKS, WIDTH, ERRORS = 10, 6, 1
PERMUTATIONS = CHUNKS * WIDTH
#: Distance is counted on the low PLANES bits of each value, kept as bit planes (one 64-bit word per bit), so that
#: a join condition can count differing positions with bit operations.
PLANES = 4
#: Signatures that differ in more positions are not compared on full sets.  At similarity 0.8 about 11 of 60 differ
#: (standard deviation 3): 27 is more than five deviations away.
MAX_DISTANCE = 27
#: Guaranteed by the pigeonhole split: every pair at most this far apart shares a masked chunk.
GUARANTEED_DISTANCE = CHUNKS * (ERRORS + 1) - 1
STAR_ROUNDS = 2
#: Bounds of one block of a family (a block pair is compared in one task).
BLOCK_ROWS, BLOCK_SHINGLES = 256, 200_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS MinHash values, 12 bits each."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = hashes[at:at + 4096]
            least = np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
        return mix64(least) >> np.uint64(52)


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """Word k holds bit k of every position of a signature."""
    place = np.arange(PERMUTATIONS, dtype=np.uint64)
    return np.array([np.bitwise_or.reduce(((sig >> np.uint64(k)) & np.uint64(1)) << place) for k in range(PLANES)],
                    np.uint64).view(np.int64)


def distance(a: str, b: str) -> Column:
    """Positions in which two signatures differ, from their plane arrays."""
    word = [F.col(a)[k].bitwiseXOR(F.col(b)[k]) for k in range(PLANES)]
    return F.bit_count(word[0].bitwiseOR(word[1]).bitwiseOR(word[2]).bitwiseOR(word[3]))


_SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()),
                     ("planes", pa.list_(pa.int64()))])
_SIGNED_SQL = "id long, n long, digest binary, sig binary, planes array<long>"
_SETS = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64())])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, digest, sig, planes = [], [], [], []
            for text in part.column("text").to_pylist():
                h = shingle_set(words(text), size)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                values = signature(h) if len(h) else None
                sig.append(None if values is None else values.astype("<u2").tobytes())
                planes.append(None if values is None else bit_planes(values))
            yield record_batch(_SIGNED, part.column("id"), n, digest, sig, planes)
    return run


def _set_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield record_batch(_SETS, part.column("id"),
                               [shingle_set(words(t), size).tobytes() for t in part.column("text").to_pylist()])
    return run


def _masked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 8192):
        ids = part.column("id").to_numpy()
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = []
        with np.errstate(over="ignore"):
            for chunk in range(CHUNKS):
                for mask in range(WIDTH):
                    rest = [sig[:, chunk, p] for p in range(WIDTH) if p != mask]
                    packed = np.zeros(len(ids), np.uint64)
                    for symbol in rest:
                        packed = packed << np.uint64(12) | symbol
                    keys.append(mix64(packed ^ mix64(np.array([chunk * WIDTH + mask + 1], np.uint64))))
        yield record_batch(_KEYS, np.concatenate(keys).view(np.int64), np.tile(ids, len(keys)))


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = []
            for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _forest(percent: int):
    """Spanning forest ``(a, b)`` of the links inside one block pair of a family."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sets = [sets[k] for k in order]
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        at, owner = number[column][shared[column]], owner[shared[column]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        by_column = np.argsort(at, kind="stable")
        at, owner = at[by_column], owner[by_column]
        for low in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(at, (low, low + 4096))
            member = np.zeros((len(sets), 4096), np.float32)
            member[owner[i:j], at[i:j] - low] = 1
            both += member @ member.T
        both = np.rint(both).astype(np.int64)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        a, b, left = [], [], np.ones(len(sets), bool)
        for k in range(len(sets)):
            if not left[k]:
                continue
            reached = new = linked[k].copy()
            while new.any():
                new = linked[new].any(axis=0) & ~reached
                reached = reached | new
            reached[k] = False
            left &= ~reached
            a += [ids[k]] * int(reached.sum())
            b += ids[reached].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links inside families, by blocks: a member goes to every block pair that holds its block."""
    rows = families.join(sets, "id").withColumn("n", (F.length("hashes") / 8).cast("long"))
    blocks = rows.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = (rows.join(blocks, "component")
             .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    return (dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "hashes")
            .groupBy("component", "x", "y").applyInArrow(_forest(percent), "a long, b long").where("a <> b").distinct())


def _planes(sigs: DataFrame, name: str) -> DataFrame:
    return sigs.select(F.col("id").alias(name), F.col("planes").alias(f"planes_{name}"))


def _with_family(rows: DataFrame, families: DataFrame | None) -> DataFrame:
    if families is None:
        return rows.withColumn("component", F.col("id"))
    return (rows.join(families, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def _shared(keys: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes."""
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(several, "key")


def _star_pairs(members: DataFrame, sigs: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with the bucket's centre (turn 0: the smallest id, later: hash-chosen), if their
    signatures are close and their families differ."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    centre = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "component")).alias("c"))
    apart = members.join(centre, "key").where("component <> c.component")
    pairs = apart.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
    return (pairs.join(_planes(sigs, "a"), "a").join(_planes(sigs, "b"), "b")
            .where(distance("planes_a", "planes_b") <= MAX_DISTANCE).select("a", "b").distinct())


def _open_pairs(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of a bucket that lie in different families and whose signatures are close."""
    span = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = members.join(span.select("key"), "key", "left_semi").join(sigs, "id")
    a, b = (left.select("key", F.col("id").alias(c), F.col("component").alias(f"comp_{c}"),
                        F.col("planes").alias(f"planes_{c}")) for c in "ab")
    return (a.join(b, "key").where("a < b and comp_a <> comp_b")
            .where(distance("planes_a", "planes_b") <= MAX_DISTANCE).select("a", "b").distinct())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar."""
    full = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))
    return (pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(_similar(percent), "a long, b long").distinct())


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of each id that has several: one per further class."""
    several = (signed.where("id is not null and digest is not null").groupBy("id")
               .agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id"))
    named = (signed.join(several, "id", "left_semi").select(F.col("id").alias("doc"), "digest").distinct()
             .join(classes.select("digest", F.col("id").alias("b")), "digest"))
    first = named.groupBy("doc").agg(F.min("b").alias("a"))
    return named.join(first, "doc").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept`` (kept: the smallest id of its component).

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` over their ``shingle``-word sets; components
    follow links.  Defined cases: a NULL or word-less text has an empty set and is linked with nothing; a text with
    fewer words than a shingle is one shingle; rows that repeat an id are one document, linked if any of its texts is;
    a row with a NULL id is linked with nothing (component_id NULL, kept true); an empty table gives no rows; further
    columns are ignored.  Texts are read whole, however long.
    """
    source = id_text(docs, id_col, text_col, binary=True)
    signed = cut(source.mapInArrow(_sign(shingle), _SIGNED_SQL), "signed")
    classes = cut(signed.where("id is not null and digest is not null").groupBy("digest")
                  .agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("planes").alias("planes")), "classes")
    sigs = classes.select("id", "planes")
    keys = cut(_shared(classes.select("id", "sig").mapInArrow(_masked_chunks, "key long, id long").distinct()), "buckets")
    close, families = None, None
    for turn in range(STAR_ROUNDS):
        more = cut(_star_pairs(_with_family(keys, families), sigs, turn), "close")
        close = more if close is None else close.unionAll(more)
        families = cut(connected_components(close), "families")
    across = cut(_open_pairs(_with_family(keys, families), sigs), "across")
    wanted = families.select("id").unionAll(across.select("a")).unionAll(across.select("b")).distinct()
    sets = cut(source.join(wanted, "id", "left_semi").mapInArrow(_set_of(shingle), "id long, hashes binary")
               .where("length(hashes) > 0").distinct(), "sets")
    links = cut(_family_links(families, sets, percent).unionAll(_confirm(across, sets, percent))
                .unionAll(_same_id(signed, classes)), "links")
    components = connected_components(links)
    of_class = (classes.select("digest", "id").join(components, "id", "left")
                .select("digest", F.coalesce("component", "id").alias("component_id")))
    return (signed.join(of_class, "digest", "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))

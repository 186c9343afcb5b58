"""Vector codes and filter audit: brute force on small fixtures with every odd case."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from gaugeline.llm import vector_codes as vc
from gaugeline.llm.filter_audit import FILTERS, audit
from tests.llm.conftest import as_documents

# ---- vector codes


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                         *[T.StructField(c, T.StringType()) for c in ("pos", "part", "n", "code", "error", "v", "vid", "of", "id")]])
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], kind)


def brute_codes(rows, rounds=vc.ROUNDS):
    """Plain loops over the rows, one vector and one entry at a time."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cut = [(size * p // 8, size * (p + 1) // 8) for p in range(8)]
    books = [[r[1][lo:hi] for r in kept[:16]] for lo, hi in cut]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for (lo, hi), book in zip(cut, books, strict=True):
            chosen = [best(r[1][lo:hi], book)[1] for r in kept]
            for k in set(chosen):
                own = [r[1][lo:hi] for r, c in zip(kept, chosen, strict=True) if c == k]
                book[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    coded = []
    for i, v, lab in kept:
        found = [best(v[lo:hi], book) for (lo, hi), book in zip(cut, books, strict=True)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, sum(x[2] for x in coded if x[3] == lab), digest) for i, c, e, lab in coded], key=str)


def check_codes(spark, rows):
    got = sorted([tuple(r) for r in vc.vector_codes(vectors(spark, rows)).collect()], key=str)
    assert got == brute_codes(rows)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=24).astype("float32").tolist(), int(i) % 3) for i in rng.permutation(150)]
    check_codes(spark, rows)


def test_codes_of_odd_vectors(spark):
    """Repeated ids and vectors, ties between entries, NULL ids and labels, unusable vectors, other dimensions."""
    rng = np.random.default_rng(2)
    grid = rng.integers(-2, 3, size=(60, 16)).astype(float).tolist()  # few values: many ties and shared prefixes
    rows = [(i, v, None if i % 4 == 0 else i % 2) for i, v in enumerate(grid)] + [(7, grid[7], 1), (7, grid[8], None), (None, grid[3], 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [None], 1), (903, [math.nan] * 16, 1), (904, [math.inf] + [0.0] * 15, 1), (905, [1.0] * 8, 1)]
    rows += [(906 + k, grid[0], 5) for k in range(80)]  # one vector fills a good part of the table
    check_codes(spark, rows)


def test_codes_of_few_odd_sized_and_no_vectors(spark):
    check_codes(spark, [(3, [0.5, -0.25, 1.0, 2.0, -3.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 1), (1, [0.0] * 11, None)])
    check_codes(spark, [(1, [0.5, -0.5, 0.25], 1), (2, [0.1, 0.2, 0.3], 2)])  # fewer components than parts
    assert vc.vector_codes(vectors(spark, [])).collect() == [] == vc.vector_codes(vectors(spark, [(1, None, 1)])).collect()


def test_very_large_components_stay_exact(spark):
    rows = vc.vector_codes(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).collect()
    assert [r.error for r in rows] == [0, 0] and sorted(r.code for r in rows) == ["00" * 8, "01" * 8]


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
def test_trie_distances(block):
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(-2, 3, size=(300, 5)), axis=0)
    entries = rng.integers(-3, 4, size=(16, 5))
    plain = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (vc.trie_distances(rows, entries, block) == plain).all()


# ---- filter audit


def brute_audit(rows, langs, labels):
    texts = [t or "" for _, t, _ in rows]
    failed = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, texts, strict=True))
        failed.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                       "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller})
    good = [any(d == i and q == 1 for d, q, _ in labels) and i is not None for i, _, _ in rows]
    bad = [any(d == i and x == 1 for d, _, x in labels) and i is not None for i, _, _ in rows]
    out = []
    for part in {lang or "" for lang in langs}:
        own = [k for k, lang in enumerate(langs) if (lang or "") == part]
        removed = dict.fromkeys(FILTERS, 0)
        found = []
        for order in itertools.permutations(FILTERS):
            left = list(own)
            for step, f in enumerate(order, 1):
                hit = [k for k in left if failed[k][f]]
                redundant = sum(failed[k][f] for k in own) - len(hit)
                left = [k for k in left if not failed[k][f]]
                removed[f] += len(hit)
                alone = sum(failed[k][f] and sum(failed[k].values()) == 1 for k in own)
                found.append((part, "".join(order), step, len(left), len(hit), redundant, alone, sum(good[k] for k in hit), sum(bad[k] for k in hit)))
        out += [(*r, removed[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_audit_equals_brute_force(spark, odd_rows):
    words = " ".join(f"w{k}" for k in range(120))
    rows = odd_rows + [(20, words, "a"), (21, words, "a"), (21, words, "a"), (20, words, "b"), (22, words + " #", "b"), (23, "same " * 150, None),
                       (24, "CAPS " * 120, "c"), (25, words.upper() + " $", "c"), (None, words, "a"), (26, None, "a"), (27, "x" * 200_000, "a")]
    docs = as_documents(spark, rows).drop("lang")
    # the part is the source here, so that NULL, empty and shared parts occur
    langs = [s for _, _, s in rows]
    marks = [(1, 1, 0), (1, 0, None), (3, 0, 1), (20, 1, 1), (21, 1, None), (22, None, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "x", "y") for m in marks], "doc_id long, quality int, toxic int, part string, mask string")
    got = sorted(tuple(r) for r in audit(docs, labels, part_col="source").collect())
    assert got == brute_audit(rows, langs, marks)


def test_audit_of_no_documents_and_no_labels(spark, no_docs, odd_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(no_docs, none).collect() == []
    rows = audit(odd_docs, none, part_col="source").collect()
    assert len(rows) == 600 * len({s or "" for _, _, s in odd_rows}) and not any(r.good_lost or r.toxic_lost for r in rows)
    assert all(r.step == len(r.filter_order[:r.step]) and r.kept >= 0 for r in rows)

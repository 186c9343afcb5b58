"""Language-model scores, quality and toxicity: brute force on small fixtures, held-out accuracy on the given tables."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import ppm
from gaugeline.llm.quality import STATISTICS, isotonic, quality_scores, statistics
from gaugeline.llm.toxicity import toxicity

ORDER = ppm.ORDER


def held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def low(text):
    return (text or "").encode().lower().split()


def brute_ppm(train, scored):
    grams = [collections.defaultdict(collections.Counter) for _ in range(ORDER + 1)]
    stream = lambda t: b"\n" * ORDER + b" ".join(low(t)) + b"\n"
    for text in train:
        s = stream(text)
        for k in range(ORDER, len(s)):
            for o in range(ORDER + 1):
                grams[o][s[k - o:k]][s[k]] += 1

    def one(context, symbol):
        gone, lp = set(), 0.0
        for o in range(ORDER, -1, -1):
            rest = {s: n for s, n in grams[o].get(context[ORDER - o:], {}).items() if s not in gone}
            if rest:
                total = 2 * sum(rest.values())
                if symbol in rest:
                    return lp + math.log10((2 * rest[symbol] - 1) / total)
                lp += math.log10(len(rest) / total)
                gone |= set(rest)
        return lp + math.log10(1 / (256 - len(gone)))
    return [sum(one(s[k - ORDER:k], s[k]) for k in range(ORDER, len(s))) for s in map(stream, scored)]


def check_scores(spark, docs, rows, **options):
    got = collections.defaultdict(list)
    for r in ppm.score_texts(docs, **options).collect():
        got[r.id].append(r)
    train = [t for i, t in rows if not held(i, 7, 2)]
    count = collections.Counter(w for t in train for w in [*low(t), b"\n"])
    n, v = sum(count.values()), len(count)
    for (i, t), score in zip(rows, brute_ppm(train, [t for _, t in rows]), strict=True):
        ws = [*low(t), b"\n"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert any(r.n_tokens == len(ws) and r.n_known == sum(w in count for w in ws) and r.train_tokens == n and r.held_out == held(i, 7, 2)
                   and abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - score) < 1e-4 * max(1, -score) for r in got[i])
    assert sum(map(len, got.values())) == len(rows)


def test_ppm_matches_brute_force(spark, odd_docs, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows]
    check_scores(spark, odd_docs, rows)
    check_scores(spark, odd_docs, rows, head_words=3)


def test_ppm_is_the_same_whatever_a_task_holds(spark, odd_docs, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows]
    for nodes in (0, 20, 2000):
        check_scores(spark, odd_docs, rows, trie_nodes=nodes, head_words=3)


def test_ppm_joins_equal_the_held_trie_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_trie, joined = (ppm.score_texts(docs, **o).select("id", F.col("score").alias(name)) for name, o in (("a", {}), ("b", {"trie_nodes": 1000})))
    both = held_trie.join(joined, "id")
    assert both.count() == docs.count() and both.where("abs(a - b) > 1e-5 * greatest(1, -a)").count() == 0


def test_ppm_beats_the_base_on_held_out_texts(spark):
    got = ppm.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_ppm_without_training_and_with_a_small_trie(spark, odd_docs, no_docs):
    only_held = odd_docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = ppm.score_texts(only_held).collect()
    assert got and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in ppm.score_texts(odd_docs, trie_nodes=20).collect())
    assert ppm.score_texts(no_docs).count() == 0


def test_a_context_is_a_distribution():
    texts = [[b"abra", b"cadabra"], [b"banana"], []]
    win, _ = ppm.windows(texts)
    keys = [np.unique(win & np.uint64((1 << 8 * (o + 1)) - 1), return_counts=True) for o in range(ORDER + 1)]
    model = ppm.ByteModel(keys)
    for context in (b"abra ", b"xxxxx", b"banan", b"\n\n\n\n\n"):
        own = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10.0 ** model.log10(own)).sum() - 1) < 1e-5


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = np.sort(rng.normal(size=50))
    knots, rates = isotonic(x, np.full(50, 4.0), rng.integers(0, 5, 50).astype(float))
    assert (np.diff(rates) >= 0).all() and (np.diff(knots) > 0).all()


def test_statistics_have_one_length():
    assert {len(statistics(t)) for t in (None, b"", b" ", b"\n\n", b"a", "é|!".encode(), b"x y\n" * 9)} == {STATISTICS}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, F.col("id") == F.col("doc_id")).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (8, 1, "x"), (10, None, "x"), (None, 1, "x")], "doc_id long, quality int, stats string")
    got = quality_scores(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_scores(odd_docs, labels.where("false")).collect()} == {0.5}
    assert quality_scores(no_docs, labels).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, labels.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "said").join(labels, F.col("id") == F.col("doc_id")).where("doc_id % 3 = 0").collect()
    assert sum(r.said for r in scored if not r.toxic) == 0
    assert sum(r.said for r in scored if r.toxic) >= 0.85 * sum(r.toxic for r in scored)


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 1, "x"), (2, 0, 0, "x"), (2, 0, 1, "x"), (8, None, 0, "x"), (10, 1, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    assert toxicity(odd_docs, labels).count() == len(odd_rows)
    assert toxicity(odd_docs, labels.where("false")).where("toxic").count() == 0
    assert toxicity(no_docs, labels).count() == 0


def test_merged_counts_are_whole_numbers():
    parts = [(np.array(k, np.uint64), np.array(n, np.int64)) for k, n in (([1, 5, 2**47], [2**53, 1, 2]), ([1, 7], [1, 4]), ([], []), ([5, 2**47], [3, 3]))]
    key, n = ppm._merged(parts)
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {1: 2**53 + 1, 5: 4, 7: 4, 2**47: 5} and (np.diff(key.astype(np.int64)) > 0).all()
    assert [len(x) for x in ppm._merged([(np.empty(0, np.uint64), np.empty(0, np.int64))])] == [0, 0]

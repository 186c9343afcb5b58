"""Near duplicates of texts and vectors against brute force."""

import itertools
import random

import numpy as np
import pytest

from gaugeline.llm import minhash_dedup as M
from gaugeline.llm.common import shingle_set, words
from gaugeline.llm.components import connected_components
from gaugeline.llm.embedding_dedup import embedding_duplicates
from tests.llm.conftest import as_documents


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 12)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (500, 139)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 13)} | {k: 100 for k in range(100, 140)} | {500: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def tuple_set(text, size):
    ws = words((text or "").encode())
    k = min(size, len(ws))
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if ws else set()


@pytest.mark.parametrize("size", [1, 4, 5])
def test_shingles_are_counted_like_tuples(size):
    for text in ("", "a", "a b c d e f", "a b a b a b a b", "A b\tC\nd e f"):
        assert len(shingle_set(words(text.encode()), size)) == len(tuple_set(text, size))


def test_masked_chunks_meet_for_every_pair_in_reach():
    """Pigeonhole: signatures at a distance up to GUARANTEED_DISTANCE share a masked chunk."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 4096, M.PERMUTATIONS)
        b = a.copy()
        b[rng.choice(M.PERMUTATIONS, M.GUARANTEED_DISTANCE, replace=False)] ^= 1
        batch = pa.RecordBatch.from_pydict({"id": [0, 1], "sig": [x.astype("<u2").tobytes() for x in (a, b)]})
        out = next(M._masked_chunks(iter([batch]))).to_pydict()
        keys = [{k for k, i in zip(out["key"], out["id"], strict=True) if i == n} for n in (0, 1)]
        assert keys[0] & keys[1]


def near_family(rng, size, words_each):
    base = [f"w{rng.randrange(5000)}" for _ in range(words_each)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        yield " ".join(own)


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)  # several blocks in the large family
    rng = random.Random(3)
    texts = [*near_family(rng, 60, 60), *near_family(rng, 8, 40), *[" ".join(f"r{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]]
    texts += texts[:10]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = {i: tuple_set(t, 5) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) > 0
    want = brute_components(sorted(sets), linked)
    got = M.near_duplicates(as_documents(spark, [(i, t, "a") for i, t in rows])).collect()
    assert {r.id: r.component_id for r in got} == want
    assert {r.id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = M.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    component = {r.id: r.component_id for r in got if r.id is not None}
    assert [component[k] for k in (1, 2, 3)] == [1, 1, 1]
    assert [component[k] for k in (4, 5, 6, 8, 12)] == [4, 5, 6, 8, 12]
    assert component[9] == 7 and component[11] == 10
    assert all(r.kept and r.component_id is None for r in got if r.id is None)
    assert {r.n_shingles for r in got if r.id in (4, 5, 6)} == {0}
    assert M.near_duplicates(no_docs).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(20))
    rows = [(1, text("a")), (12, text("a")), (12, text("b")), (20, text("b") + " more"), (30, text("c")), (30, text("d")), (31, text("e"))]
    got = {(r.id, r.component_id, r.kept) for r in M.near_duplicates(as_documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == {(1, 1, True), (12, 1, False), (20, 1, False), (30, 30, True), (31, 31, True)}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 32))
    close = np.concatenate([b + rng.normal(size=(6, 32)) * s for b, s in zip(base[:20], np.linspace(0.02, 0.4, 20), strict=True)])
    x = np.concatenate([base, close, close[:5], 3 * close[5:8]]).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    got = {r.id: r for r in embedding_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    found = sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= true[k].sum() for k in got)
    assert found >= 0.9 * true.sum()
    if found == true.sum():
        want = brute_components(range(len(x)), lambda a, b: true[a, b])
        assert {k: r.component_id for k, r in got.items()} == want


def test_embeddings_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 3e38
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [big, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, v string, id string")
    got = embedding_duplicates(df).collect()
    assert len(got) == len(rows)
    links = {r.id: r.n_links for r in got}
    assert links[1] == 3 and links[2] == 3 and links[10] == 3
    assert [links[k] for k in (3, 4, 5, 6, 7, 8, 9, None)] == [0] * 8
    assert {r.id: r.component_id for r in got}[10] == 1
    assert embedding_duplicates(df.where("false")).count() == 0

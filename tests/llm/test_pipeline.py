"""The corpus pipeline: each stage against a brute-force version of its decision."""

import pytest

import corpus_pipeline as P
from tests.llm.conftest import LONG, as_documents
from tests.llm.test_text_scans import brute_secrets, shingles


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    plain = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(60)]
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(plain)]
    rows += [(100 + k, plain[k] + " extra", "s0") for k in range(5)] + [(200 + k, f"{LONG} idiot{k % 2} moron " + plain[k], "s1") for k in range(20)]
    rows += [(300, plain[59][::-1] + " " + item, "s2"), (301, "my password=abcdefghijkl1234 " + plain[58][::-1], None), (302, None, "s0"), (302, None, "s0"), (303, "", "s1"), (None, "no id here", "s1")]
    as_documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(k, 1, 0) for k in range(40)] + [(200 + k, 1, 1) for k in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    before = texts(docs)
    clean = P.drop_toxic(spark, docs, sf_dir)
    assert texts(clean) == {x for x in before if x[0] is None or not 200 <= x[0] < 300}
    single = P.drop_near_duplicates(spark, clean, sf_dir)
    assert texts(single) == {x for x in texts(clean) if x[0] is None or not 100 <= x[0] < 200}
    assert single.where("doc_id = 302").count() == 1
    fair = P.drop_contaminated(spark, single, sf_dir)
    item = shingles(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)
    assert texts(fair) == {x for x in texts(single) if x[0] is None or len(shingles(x[1]) & item) < 0.8 * len(item)} and len(texts(fair)) == len(texts(single)) - 1
    safe = P.redact_secrets(spark, fair, sf_dir)
    assert safe.count() == fair.count() and not any(brute_secrets(r.text) for r in safe.collect())
    assert safe.where("doc_id = 301").first().text.startswith("my [SECRET] ") and safe.where("n_chars <> length(text)").count() == 0
    assert all(x.columns == docs.columns and x.dtypes == docs.dtypes for x in (clean, single, fair, safe))
    mixed = P.mix_sources(spark, safe, sf_dir)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in safe.collect()}


def test_near_duplicates_are_dropped_per_text(spark, sf_dir):
    """The copy goes, whatever the order of the texts; another text under the same id stays."""
    a, b, c = (" ".join(f"{name}{k}" for k in range(30)) for name in "abc")
    docs = as_documents(spark, [(1, a, "s"), (12, a, "s"), (12, b, "s"), (13, c, "s"), (13, c, "s"), (14, b + " more", "s"), (14, "", "s"), (14, None, "s")])
    got = P.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (12, b), (13, c), (14, ""), (14, None)], key=str)
    assert got.columns == docs.columns


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(P.run(spark, sf_dir)) == key(docs)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name

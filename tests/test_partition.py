"""Partition assignment: golden values, driver/JVM agreement, spread."""

import hashlib

from pyspark.sql import functions as F

from gaugeline.functions.partition import partition_id, partition_id_of
from gaugeline.operators.partitioning import partition_balance

# Fixed values: (uuid, partition with n=3, partition with n=5).
GOLDEN = [
    ("uuid-001", 0, 2), ("uuid-002", 0, 4), ("uuid-1", 2, 2), ("uuid-2", 1, 2), ("uuid-3", 0, 1),
    ("uuid-4", 0, 4), ("uuid-5", 1, 1), ("test-uuid-123", 2, 3), ("same-uuid", 1, 3), ("", 1, 0),
    ("test-uuid-same", 1, 1), ("test-uuid-multi-group", 1, 0),
    ("GPU-0aba4c65-be7d-8418-977a-c950c14b989a", 2, 2),
    ("aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa", 0, 3), ("bbbbbbbb-bbbb-bbbb-bbbb-bbbbbbbbbbbb", 2, 2),
    ("cccccccc-cccc-cccc-cccc-cccccccccccc", 0, 4),
]


def test_golden_values(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in GOLDEN], "uuid string")
    got = {r.uuid: (r.p3, r.p5) for r in
           df.select("uuid", partition_id("uuid", 3).alias("p3"), partition_id("uuid", 5).alias("p5")).collect()}
    for u, p3, p5 in GOLDEN:
        assert got[u] == (p3, p5), u
        assert partition_id_of(u, 3) == p3 and partition_id_of(u, 5) == p5


def test_matches_hashlib_many(spark):
    us = [f"dev-{i}-{'x' * (i % 7)}" for i in range(500)] + ["ünïcode-ß", "a" * 300]
    df = spark.createDataFrame([(u,) for u in us], "uuid string")
    for n in (2, 3, 7, 64):
        got = {r.uuid: r.p for r in df.select("uuid", partition_id("uuid", n).alias("p")).collect()}
        for u in us:
            assert got[u] == sum(map(ord, hashlib.sha256(u.encode()).hexdigest())) % n


def test_spread_and_balance(spark):
    df = spark.createDataFrame([(f"test-uuid-{i}",) for i in range(100)], "uuid string")
    bal = {r.partition_id: (r.records, r.devices) for r in partition_balance(df, 3).collect()}
    assert {k: v[0] for k, v in bal.items()} == {0: 29, 1: 38, 2: 33}
    assert all(r == d for r, d in bal.values())


def test_no_python_in_plan(spark):
    from gaugeline.plans import has_python_eval
    df = spark.range(10).select(F.col("id").cast("string").alias("uuid"))
    assert not has_python_eval(df.select(partition_id("uuid", 3)))

"""Poisson replication against a plain inversion, its means, and edge cases."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing

SCHEMA = "doc_id long, source string, copy string"


def uniform(seed, doc_id):
    return int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)


def drawn(u, rate):
    if rate == 0:
        return 0
    k, total = 0, 0.0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if u < total or k > rate + 12 * math.sqrt(rate) + 30:
            return k
        k += 1


def rates(rows, weights, default=1.0, wanted=None):
    n = Counter(s for _, s, _ in rows)
    w = {s: weights.get(s, default) for s in n}
    total = sum(w.values())
    return {s: (w[s] * (wanted or len(rows)) / (total * n[s]) if total else 0.0) for s in n}


@pytest.mark.parametrize("weights", [{}, {"a": 3.0, "b": 0.0}, {"c": 50.0}])
def test_against_plain_inversion(spark, weights):
    rows = [(k, "a" if k % 3 else "b", "x") for k in range(300)] + [(1000, "c", "x"), (1001, None, "x"), (1001, None, "x"), (None, "a", "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs, weights=weights, seed=7).collect())
    rate = rates(rows, weights)
    wanted = Counter()
    for i, s, _ in rows:
        wanted[i, s] += drawn(uniform(7, i), rate[s])
    assert got == +wanted


def test_copies_and_places(spark):
    docs = spark.createDataFrame([(k, "s", "x") for k in range(200)], SCHEMA)
    mixed = mixing.mix(docs, rows_wanted=600)
    rows = mixed.collect()
    per = Counter(r.doc_id for r in rows)
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, n + 1)) for i, n in per.items())
    assert all(r.place == hashlib.md5(f"42|{r.doc_id}|{r.copy}".encode()).hexdigest() for r in rows)
    parts = [r[0] for r in mixed.groupBy(F.spark_partition_id()).agg(F.collect_list("place")).select("collect_list(place)").collect()]
    assert all(p == sorted(p) for p in parts)
    assert 500 < len(rows) < 700 and mixed.columns == ["doc_id", "source", "copy", "place"]


def test_large_rates(spark):
    """A rate in the thousands: the distribution starts far from 0."""
    docs = spark.createDataFrame([(k, f"s{k}", "x") for k in range(12)], SCHEMA)
    got = Counter(r.doc_id for r in mixing.mix(docs, rows_wanted=12 * 5000).collect())
    assert got == {k: drawn(uniform(42, k), 5000.0) for k in range(12)}


def test_weights_are_met(spark):
    rows = [(k, "hot" if k % 4 else "cold", "x") for k in range(8000)]
    got = Counter(r.source for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), weights={"hot": 1.0, "cold": 1.0}).collect())
    assert got["hot"] == pytest.approx(4000, rel=0.05) and got["cold"] == pytest.approx(4000, rel=0.08)


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"s{k % 5}" if k % 5 else None, "x") for k in range(100)], SCHEMA)
    wanted = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 100)
    assert sorted(map(str, mixing.mix(docs).collect())) == wanted


def test_rows_of_one_place_are_split(spark, tmp_path):
    """Rows with a null id have one place a copy; they don't fill one partition."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(8)
    wanted = drawn(uniform(42, None), 1.0)
    mixed = mixing.mix(docs, rows_wanted=20_000 if wanted else 60_000)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        mixed.write.parquet(f"{tmp_path}/mixed")
        sizes = [r[1] for r in spark.read.parquet(f"{tmp_path}/mixed").groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", "x")], SCHEMA), default_weight=0.0).count() == 0

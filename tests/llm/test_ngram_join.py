"""The n-gram Jaccard join against all pairs, and what its parts promise."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ngram_join
from rasterloom.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    names = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, names[find(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(n, words=60, seed=1, first=100, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(copy)))
    return out


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two three"), (7, "a b c d e f g"), (8, "a b c d e f g"), (8, "a b c d e f g"), (9, "x " * 5000), (None, "a b c d e f g"), (10, "A b c d e f g"), (None, None), (11, "x " * 10)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumn("key", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str)
    assert got == brute(EDGES)


def test_near_copies(spark):
    rows = near_copies(40) + near_copies(15, words=12, seed=2, first=500) + near_copies(3, seed=3, first=900) + [(2000 + k, f"alone {k} " * 20) for k in range(5)]
    got = sorted((tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_groups_in_chunks(spark, monkeypatch):
    """The same links when a group is verified in many pairs of chunks, and when texts are joined rather than filtered."""
    rows = near_copies(60, edits=6)
    wanted = brute(rows)
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 7)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str) == wanted
    monkeypatch.setattr(ngram_join, "FILTER_IDS", 3)
    assert sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str) == wanted


def test_components_of_many_chunks(spark, monkeypatch):
    """The same links when large components are verified by (band, value): chains, near copies, and buckets cut into chunks."""
    words = [f"c{k}" for k in range(400)]
    chain = [(2000 + k, " ".join(words[2 * k : 2 * k + 60])) for k in range(120)]  # neighbours share 54 of 58 shingles
    rows = near_copies(50, edits=5) + chain + near_copies(6, seed=9, first=900)
    wanted = brute(rows)
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 5)
    monkeypatch.setattr(ngram_join, "MOST_CHUNKS", 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str) == wanted


def test_a_long_chain_sends_each_set_once_a_band_at_most(spark):
    """50,000 classes of one component, of which each meets the next in one band: not all pairs of chunks."""
    bands = 24
    own = lambda k: F.concat(*[F.unhex(F.lpad(F.hex(F.when((F.col("id") + 1) % bands == b, F.col("id") + 1 + 10**9).when(F.col("id") % bands == b, F.col("id") + 10**9).otherwise(F.col("id") * 100 + b + 10**12)), 16, "0")) for b in range(bands)])
    members = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.lit(b"r").alias("root"), F.lit(1).cast("long").alias("copies"), F.lit(400).cast("long").alias("bytes"), own(0).alias("hashes"))
    dealt = ngram_join._dealt(members, bands)
    assert dealt.groupBy("key").agg(F.sum("chunks").alias("n")).agg(F.max("n")).first()[0] <= 2
    assert dealt.groupBy("root", "band").count().agg(F.max("count")).first()[0] == 2
    together = members.withColumn("hashes", F.unhex(F.lit("00" * 8 * bands)))  # all meet in all bands: the component as a whole sends less
    assert ngram_join._dealt(together.limit(3000), bands).select("band", "chunks").distinct().collect() == [(-1, -(-3000 // ngram_join.CHUNK_CLASSES))]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str) == brute(rows)


def test_deduplicate(spark):
    rows = [(i, t, "copy") for i, t in [*EDGES, *near_copies(10)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = [r.doc_id for r in ngram_join.deduplicate(docs).collect()]
    plain = [(i, t) for i, t, _ in rows]
    names = {c for _, c, _ in brute(plain) if c is not None}
    assert sorted(got, key=str) == sorted([*names, None, None], key=str) and 8 in {i for i, _ in plain} - names
    assert ngram_join.deduplicate(docs).columns == docs.columns


def test_deduplicate_tells_repeated_and_null_ids_by_their_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (5, c), (5, c + " "), (None, d), (None, d), (None, d + " "), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [sorted(((r.doc_id, r.text) for r in ngram_join.deduplicate(docs.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert found[0] == found[1]
    assert sorted(((i, t and t.strip()) for i, t in found[0]), key=str) == sorted([(1, a), (5, b), (5, c), (None, d), (9, None), (None, None)], key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.link(none).count() == ngram_join.deduplicate(none).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.95), (0.5, 0.99), (1.0, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.9999)


@pytest.mark.parametrize("right", [False, True])
def test_both_ways_to_verify_agree(right, monkeypatch):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 40, 5).astype(np.uint64)])) for _ in range(30)]
    left, other = (sets[:12], sets[12:]) if right else (sets, None)
    shape = (len(left), len(other or left))
    every = np.ones(shape, bool)
    wanted = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in (other or left)] for a in left])
    assert 0 < wanted.sum() < wanted.size and np.array_equal(ngram_join._linked(left, other, every, 0.8), wanted)
    few = np.zeros(shape, bool)
    few[0, 1] = few[3, 2] = True
    assert np.array_equal(ngram_join._linked(left, other, few, 0.8), wanted & few)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(40)] + [(300, k) for k in range(301, 330)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_batch_takes_little_memory_beside_itself():
    texts = [f"text {k} ".encode() + b"of words that go on " * 200 for k in range(1000)]
    tracemalloc.start()
    try:
        assert sum(1 for _ in ngram_join.shingle_sets(texts, 5)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 30e6  # 4 MB of texts
    finally:
        tracemalloc.stop()

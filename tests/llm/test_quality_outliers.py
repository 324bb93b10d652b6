"""Base statistics against a plain count, and the outlier rule on planted rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import quality_outliers
from rasterloom.llm import quality_outliers as qo
from rasterloom.llm.queries import op6_quality_outliers

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


EDGES = [None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n\n \n x", "é😀 #|<>*$%& b", "one two three\x0bfour\x0cfive\rsix", "w " * 30_000, "a b c d e f g h i j " * 40, "same line\n" * 100, "\u00a0 \u2003"]


def base_of(rows):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}


def test_base_statistics(spark):
    docs = spark.createDataFrame([(k, t, None, "s") for k, t in enumerate(EDGES)] + [(3, EDGES[3], None, "s")], SCHEMA).withColumn("w", F.lit(1)).withColumn("n_words", F.lit("x"))
    rows = quality_outliers.judge(docs).collect()
    assert len(rows) == len(EDGES) + 1
    for r in rows:
        wanted = plain(EDGES[r.doc_id])
        assert base_of([r])[r.doc_id] == wanted, r.doc_id
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        assert r.kept == (not r.base_failed)  # a group this small isn't judged by distance


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_quality_outliers(spark, "/root/testdata/sf0.001").collect()
    assert base_of(rows) == {k: plain(t) for k, t in texts.items()} and all(not (r.kept and r.base_failed) for r in rows)


def planted(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(80, 700)))
        rows.append((k, text, "en" if k % 3 else None, "hot" if k % 2 else f"s{k % 4}"))
    for k in range(8):
        rows.append((1000 + k, " ".join("".join(rng.choices("abc", k=5)) + "%%%" for _ in range(200)), "en", "hot"))
        rows.append((2000 + k, " ".join("".join(rng.choices("abcdefgh", k=60)) for _ in range(200)), "en", "hot"))
    return rows


def test_planted_outliers(spark):
    rows = planted()
    judged = {r.doc_id: r.kept for r in quality_outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(judged[k] for k in judged if k >= 1000)
    assert sum(judged[k] for k in range(300)) >= 298


def test_result_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame(planted(seed=3), SCHEMA)
    results = [{(r.doc_id, r.kept, round(r.distance, 6)) for r in quality_outliers.judge(docs.repartition(n)).collect()} for n in (1, 13)]
    assert results[0] == results[1]


def test_empty_table(spark):
    assert quality_outliers.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distances_are_mahalanobis(spark):
    rng = np.random.default_rng(0)
    spread = rng.normal(size=(4, 4))
    cov, mean = spread @ spread.T + np.eye(4), rng.normal(size=4)
    x = rng.normal(size=(20, 4))
    params = spark.createDataFrame([("g", *mean.tolist(), *[float(cov[i, j]) for i in range(4) for j in range(i + 1)])], ["g", *[f"m{k}" for k in range(4)], *[f"c{i}{j}" for i in range(4) for j in range(i + 1)]])
    rows = spark.createDataFrame([("g", k, *map(float, v)) for k, v in enumerate(x)], ["g", "k", "x0", "x1", "x2", "x3"])
    got = {r.k: r.d2 for r in quality_outliers._distances(rows, params, True).collect()}
    wanted = [(v - mean) @ np.linalg.solve(cov, v - mean) for v in x]
    assert [got[k] for k in range(20)] == pytest.approx(wanted)


def ordinary(rng, n, first, source, lang="en"):
    return [(first + k, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(80, 700))), lang, source) for k in range(n)]


def verdicts(spark, rows):
    return {r.doc_id: r.kept for r in quality_outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_third_of_a_source_is_junk_copies(spark):
    rng = random.Random(7)
    long_words = " ".join("".join(rng.choices("abcdefgh", k=60)) for _ in range(200))
    symbols = " ".join("".join(rng.choices("abcdefgh", k=3)) + "%%" for _ in range(200))
    rows = ordinary(rng, 200, 0, "a") + ordinary(rng, 200, 200, "b") + [(1000 + k, long_words, "en", "a") for k in range(100)] + [(2000 + k, symbols, "en", "b") for k in range(100)]
    kept = verdicts(spark, rows)
    assert not any(kept[k] for k in kept if k >= 1000) and sum(kept[k] for k in range(400)) >= 398


def test_symbols_and_repeats_decide_alone(spark):
    rng = random.Random(8)
    rows = ordinary(rng, 300, 0, "a")
    for k, (share, repeats) in enumerate([(0.2, 0), (0.3, 0), (0.4, 0), (0, 0.3), (0, 0.45)]):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
        words = [w + "%" * round(len(w) * share / (1 - share)) for w in words] if share else words
        words[: round(300 * repeats)] = words[:3] * round(100 * repeats)
        rows.append((1000 + k, " ".join(words), "en", "a"))
    kept = verdicts(spark, rows)
    assert not any(kept[k] for k in kept if k >= 1000) and sum(kept[k] for k in range(300)) >= 298


def test_small_groups_are_judged_by_their_language(spark):
    rng = random.Random(9)
    odd = " ".join("".join(rng.choices("abc", k=40)) for _ in range(200))
    rows = ordinary(rng, 200, 0, "a") + ordinary(rng, 3, 200, "small") + [(1000, odd, "en", "small"), (1001, odd, "xx", "small")]
    kept = verdicts(spark, rows)
    assert not kept[1000] and not kept[1001] and all(kept[k] for k in range(200, 203))


def plain_mcd(x, rng, starts=60):
    """Least determinant of half of the rows over many random starts, concentrated until nothing moves; then one reweighting."""
    n, p = x.shape
    h, best = (n + p + 1) // 2, None
    floors = np.square(qo.FLOORS)
    for _ in range(starts):
        some = x[rng.choice(n, p + 1, replace=False)]
        mean, cov = some.mean(axis=0), np.cov(some.T, bias=True) + 1e-6 * np.eye(p)
        before = np.inf
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[:h]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * qo.CONSISTENCY
            np.fill_diagonal(cov, np.maximum(np.diag(cov), floors))
            logdet = np.linalg.slogdet(cov)[1]
            if logdet >= before - 1e-9:
                break
            before = logdet
        if best is None or logdet < best[0]:
            best = logdet, mean, cov
    logdet, mean, cov = best
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    kept = x[d <= qo.WITHIN]
    mean, cov = kept.mean(axis=0), np.cov(kept.T, bias=True) * qo.WITHIN_CONSISTENCY
    np.fill_diagonal(cov, np.maximum(np.diag(cov), floors))
    return logdet, mean, cov, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


@pytest.mark.parametrize("share", [0.0, 0.15, 0.33])
def test_estimate_equals_a_plain_least_determinant(spark, share):
    """Spreads far above the floors, so that these decide nothing: the same centre, spread and verdicts as from 60 random starts."""
    rng = np.random.default_rng(int(100 * share))
    mix = rng.normal(size=(4, 4)) + 3 * np.eye(4)
    clean = rng.normal(size=(600, 4)) @ mix.T + 20
    assert (clean.std(axis=0) > 5 * np.array(qo.FLOORS)).all()
    # as wide as the clean rows: half of all rows around a far tighter third would have the lesser determinant
    junk = rng.normal(size=(int(600 * share / (1 - share)), 4)) @ mix.T + 20 + 40 * np.array([1, -1, 0.5, 1])
    x = np.concatenate((clean, junk))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{c} double" for c in qo.DIMENSIONS))
    _, mean, cov, d = plain_mcd(x, rng)
    params = qo._estimate(rows, True)
    found = params.first()
    assert np.allclose([found[f"m{k}"] for k in range(4)], mean, atol=0.15)
    for i in range(4):
        for j in range(i + 1):
            assert abs(found[f"c{i}{j}"] - cov[i, j]) < 0.1 * math.sqrt(cov[i, i] * cov[j, j])
    told = {tuple(round(r[c], 9) for c in qo.DIMENSIONS): r.d2 for r in qo._distances(rows, params, True).collect()}
    got = np.array([told[tuple(round(float(v), 9) for v in r)] for r in x])
    clear = np.abs(d / qo.CUTOFF - 1) > 0.2
    assert ((got > qo.CUTOFF) == (d > qo.CUTOFF))[clear].all() and clear.mean() > 0.98
    assert (got[600:] > qo.CUTOFF).all() and (got[:600] <= qo.CUTOFF).mean() > 0.995

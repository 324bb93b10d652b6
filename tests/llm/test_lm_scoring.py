"""Language-model scores against a plain model in dictionaries."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import lm_scoring

SCHEMA = "doc_id long, text string"
ROWS = [
    (1, "The cat sat. The cat"), (2, "the CAT ran\tfast\nthe end"), (3, None), (4, ""), (5, "   \n"), (6, "unseen words here"), (7, "a a a a a"), (7, "a a a a a"),
    (None, "the dog"), (8, "É é caf\u00e9 \u00a0x"), (9, "long " * 3000), (10, "a\x00b c\x0bd"), (11, "The cat sat. The cat"), (12, "cat the"),
]


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words] + [None]


def plain(rows, order, mu):
    trains = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    grams, texts = Counter(), len(trains)
    for t in trains:
        stream = ["<s>"] * (order - 1) + tokens(t)
        for k in range(order - 1, len(stream)):
            for n in range(1, order + 1):
                grams[tuple(stream[k - n + 1 : k + 1])] += 1
    n_tokens = sum(c for g, c in grams.items() if len(g) == 1)
    n_types = sum(1 for g in grams if len(g) == 1)

    def probability(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n_tokens + n_types + 1) if n_tokens else 1.0
        history = gram[:-1]
        seen = texts if all(g == "<s>" for g in history) else grams[history]
        return (grams[gram] + mu * probability(gram[1:])) / (seen + mu)

    out = []
    for i, t in rows:
        words = tokens(t)
        stream = ["<s>"] * (order - 1) + words
        score = sum(math.log10(probability(tuple(stream[k - order + 1 : k + 1]))) for k in range(order - 1, len(stream)))
        base = sum(math.log10((grams[(w,)] + 1) / (n_tokens + n_types + 1)) if n_tokens else 0.0 for w in words)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(grams[(w,)] > 0 for w in words), n_tokens, base, score))
    return out


def same(got, wanted):
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_a_plain_model(spark, order):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = [tuple(r)[:7] for r in lm_scoring.score(docs, order=order, mu=5.0).collect()]
    same(got, plain(ROWS, order, 5.0))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [tuple(r)[:7] for r in lm_scoring.score(docs).collect()]
    rows = [tuple(r) for r in docs.collect()]
    same(got, plain(rows, 3, 50.0))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_probabilities_sum_to_one(spark):
    """After any history, the words seen, the end and one unknown word (of which there is one by the add-one rule) make up 1."""
    taught = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    trained = list(zip(taught, ["a b a c", "b a", ""], strict=False))
    held = [i for i in range(10_000, 200_000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    histories = ["", "a", "a b", "unknown", "unknown a"]
    tests = [(f"{h} {w}".strip(), h, w) for h in histories for w in ("a", "b", "c", "unseen")]
    rows = trained + [(i, t) for i, (t, _, _) in zip(held, tests)] + [(i, h) for i, h in zip(held[len(tests) :], histories)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, SCHEMA), mu=2.0).collect()}
    model = {h: Prefixes([t for _, t in trained], 3, 2.0, h) for h in histories}
    for h in histories:
        total = model[h].of(None)
        for i, (_, of, w) in zip(held, tests):
            if of == h:
                total += 10 ** got[i].score / (model[h].before * model[h].of(None, w))
        assert total == pytest.approx(1.0, rel=1e-9), h


class Prefixes:
    """P(word | words of a prefix) and P(prefix) by the plain model, to take the end of a scored text off again."""

    def __init__(self, trains, order, mu, prefix):
        self.rows, self.order, self.mu, self.words = [(1, t) for t in trains], order, mu, prefix.split()
        self.before = 1.0
        for k, w in enumerate(self.words):
            self.before *= self._given(self.words[:k], w)

    def _given(self, history, word):
        stream, grams = ["<s>"] * (self.order - 1) + history + [word], Counter()
        for _, t in self.rows:
            line = ["<s>"] * (self.order - 1) + tokens(t)
            for k in range(self.order - 1, len(line)):
                for n in range(1, self.order + 1):
                    grams[tuple(line[k - n + 1 : k + 1])] += 1
        tokens_, types = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
        p = (grams[(word,)] + 1) / (tokens_ + types + 1)
        for n in range(2, self.order + 1):
            h = tuple(stream[-n:-1])
            seen = len(self.rows) if set(h) == {"<s>"} else grams[h]
            p = (grams[tuple(stream[-n:])] + self.mu * p) / (seen + self.mu)
        return p

    def of(self, word, after=None):
        return self._given(self.words + ([after] if after else []), word)


def test_segments_of_long_texts_score_like_one_walk(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * i * i + i) % 17}" for i in range(300 + 7 * k))) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for order in (1, 2, 3):
        same([tuple(r)[:7] for r in lm_scoring.score(docs, order=order).collect()], plain(rows, order, 50.0))


def test_many_rows_of_one_id_and_text(spark):
    """They train and score as often as they stand there, and no block or owner gathers them."""
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text again " * 200).alias("text")).repartition(6)
    blocks = lm_scoring.blocks_of(docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("held"), F.col("text").cast("binary").alias("text")))
    sizes = [r.bytes for r in blocks.collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * lm_scoring.BLOCK_BYTES
    got = lm_scoring.score(docs).select("n_tokens", "score", "train_tokens").distinct().collect()
    assert len(got) == 1 and got[0].n_tokens == 801 and got[0].train_tokens == 3000 * 801


def test_a_block_costs_no_more_for_many_owners():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 400))).encode() for _ in range(300)]
    trains = np.ones(len(texts), bool)
    took = {}
    for bits in (7, 17):
        began = time.process_time()
        rows = list(lm_scoring.ask(0, texts, trains, 3, bits))
        took[bits] = time.process_time() - began
        assert sum(r.num_rows for r in rows) <= 3 * 400 * 300
    assert took[17] < 3 * took[7] + 0.5, took


def test_empty_table(spark):
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scoring.score(spark.createDataFrame([(held, "a b")], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_packing():
    keys = np.array([0, 5, 6, 1 << 20, 1 << 40, (1 << 40) + 1, (1 << 62) + 3, (1 << 63) - 1], np.uint64)
    begins = np.array([0, 1 << 40, 1 << 62], np.uint64)
    starts = np.array([0, 4, 6])
    sizes = np.diff(np.append(starts, len(keys)))
    found = {}
    for width, runs, packed in lm_scoring._pack_keys(keys, starts, begins):
        for run, one in zip(runs, packed, strict=True):
            found[run] = lm_scoring._unpack_keys(pa.array([one.as_py()]), width, begins[run]).tolist()
    assert [x for r in range(3) for x in found[r]] == keys.tolist()
    numbers = np.array([0, 254, 255, 256, 1 << 40, 1, 7, 300])
    got, n = lm_scoring._unpack_numbers(*lm_scoring._pack_numbers(numbers, sizes))
    assert got.tolist() == numbers.tolist() and n.tolist() == sizes.tolist()

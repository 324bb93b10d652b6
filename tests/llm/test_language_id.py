"""Language ID: held-out accuracy, the filters' promises, and edge cases."""

import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import language_id
from rasterloom.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), docs_per_language=100)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_only_training_rows_teach(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang")))
    from rasterloom.llm.queries import trains_lang

    assert "xx" not in language_id.fit(changed.where(trains_lang()))["langs"]


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the and of that with"), (4, "the and of that with"), (None, "und der die ist nicht"), (5, "und der die ist nicht " * 20_000), (6, "ж"), (7, "a"), (8, "日本語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()]
    by = dict((i, (p, s)) for i, p, s in got)
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[None][0] == by[5][0] == "de" and 0 < by[4][1] <= 1
    assert {p for _, p, _ in got} <= {*model["langs"], "und"}


def test_nothing_to_learn_from(spark):
    none = language_id.fit(spark.createDataFrame([(1, None, None), (2, "x", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the"), (2, None)], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, none).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(docs.limit(0), none).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    names = [f"l{k:03d}" for k in range(70)]
    words = {n: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}{chr(97 + k % 26)}q" for j in range(20)] for k, n in enumerate(names)}
    rows = [(f"{' '.join(w)} {j}", n) for n, w in words.items() for j in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model["filter"].shape[1] == 2
    best, score, _ = language_id.score_texts(model, [" ".join(words[n]) for n in names])
    assert [model["langs"][b] for b in best] == names and (score > 0.5).all()


def test_false_positives_are_corrected():
    """Half of the slots are set by chance, so an eighth of the n-grams hit; what the correction leaves of them is near nothing."""
    rng = np.random.default_rng(5)
    model = {"langs": ["half"], "filter": rng.integers(0, 2, (4096, 1)).astype(np.uint64), "letters": np.zeros((1, 256)), "usual": 0}
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 20_000))
    raw, corrected = (language_id.score_texts(model | {"rates": np.array([rate])}, [text])[2][0] for rate in (0.0, 0.125))
    assert 0.1 < raw < 0.15 and corrected < 0.025


def plain_grams(text):
    """4-byte windows of the folded text between two blanks whose middle two bytes are not blank."""
    folded = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()) if text else b""
    data = b" " + folded + b" "
    return [data[k : k + 4] for k in range(len(data) - 3) if 32 not in data[k + 1 : k + 3]]


def plain_verdict(model, text):
    """One text by itself, n-gram by n-gram, language by language."""
    n_slots, langs = len(model["filter"]), model["langs"]
    letters = any(unicodedata.category(c).startswith("L") for c in text or "")
    hits, grams = [0] * len(langs), plain_grams(text)
    for gram in grams:
        x = (int.from_bytes(gram, "little") + 0x9E3779B97F4A7C15) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> shift) * factor) % 2**64
        x ^= x >> 31
        for k in range(len(langs)):
            hits[k] += all(int(model["filter"][(x >> 21 * h) % n_slots, k // 64]) >> k % 64 & 1 for h in range(language_id.HASHES))
    hits = [max(0.0, (h - len(grams) * w) / (1 - w)) for h, w in zip(hits, model["rates"], strict=True)]
    if not letters:
        return "und", 0.0
    if not max(hits, default=0):
        return None, 0.0
    return langs[hits.index(max(hits))], max(hits) / sum(hits)


def test_whole_table_against_a_plain_scorer(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "42 zz", "ok", "a b", "ж ок", "x\x00y\nabc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for rows in (docs.coalesce(1), docs.repartition(7)):
        for r in language_id.identify(rows, model).collect():
            lang, score = plain_verdict(model, texts[r.k])
            assert lang in (None, r.lang_pred) and r.score == pytest.approx(score), r.k
            assert (r.lang_pred == "und") == (lang == "und")


def test_a_text_gets_one_verdict_in_any_batch(model):
    texts = ["42 zz", "the thing", "ok", "und ding", "", None, "zz", "a", "the house of that", "der", "qu'est-ce", "ж"] * 3
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(len(texts))
        best, score, cover = language_id.score_texts(model, [texts[k] for k in order])
        for k, b, s, c in zip(order, best, score, cover, strict=True):
            alone = language_id.score_texts(model, [texts[k]])
            assert (b, s, c) == (alone[0][0], alone[1][0], alone[2][0]), texts[k]


def test_rare_languages_beyond_the_bound_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [("the cat and the dog", "en")] * 4 + [("und der hund", "de")] * 3 + [("xxxx yyyy zzzz", "odd")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model["langs"] == ["de", "en"]


def test_ngrams_stay_within_texts():
    for texts in (["ab cd", "", None, "x" * 10], ["abcd"] * 3, ["x", "abc", "def", "42 zz"]):
        for first, codes, at in language_id.ngrams(texts):
            assert first == 0 and at[0] == 0 and at[-1] == len(codes)
            for k, text in enumerate(texts):
                assert [int(c).to_bytes(4, "little").replace(b"\n", b" ") for c in codes[at[k] : at[k + 1]]] == plain_grams(text)


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["x", "the cat", "ok", "", "a b", None, "ж", "und", "ab"]
    for first, codes, at in language_id.ngrams(texts):
        for k, text in enumerate(texts):
            alone = [c for _, found, _ in language_id.ngrams([text]) for c in found.tolist()]
            assert codes[at[k] : at[k + 1]].tolist() == alone, text
    code = lambda gram: int.from_bytes(gram, "little")
    assert [c for _, found, _ in language_id.ngrams(["ok"]) for c in found.tolist()] == [code(b" ok ")]
    assert codes[at[1]] == code(b" the"[:4])


def test_texts_with_letters_get_a_learned_language(spark):
    train = [("the cat and the dog of that house", "en")] * 4 + [("кот и собака в том доме", "ru")] * 3
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = ["w", "qq", "ж", "ыы", "日本語", "123", None, "the cat"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, text string")
    got = {r.k: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert [got[k][0] for k in range(8)] == ["en", "en", "ru", "ru", "en", "und", "und", "en"]
    assert all(got[k][1] == 0 for k in range(7)) and got[7][1] > 0


def test_a_batch_takes_little_memory_beside_itself():
    texts = [f"text {k} " + "of words that go on " * 200 for k in range(1000)]
    model = {"langs": ["en", "fr"], "filter": np.full((1 << 8, 1), 3, np.uint64), "rates": np.zeros(2)}
    tracemalloc.start()
    try:
        language_id.score_texts(model, texts)
        assert tracemalloc.get_traced_memory()[1] < 30e6  # 4 MB of texts
    finally:
        tracemalloc.stop()

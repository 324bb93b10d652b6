"""The stages one after another, held against plain versions of what each promises."""

import unicodedata

import pytest

import corpus_pipeline
from rasterloom.llm import mixing, sentencepiece_viterbi
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import plain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FUNCTIONS = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_all_stages(spark, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    kept = [r for r in rows.values() if any(unicodedata.category(c).startswith("L") for c in r.text or "")]
    one = FUNCTIONS["language ID"](spark, documents, SF)
    assert one.columns == COLUMNS and sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, kept), key=str)

    first = {c for i, c, _ in brute([(r.doc_id, r.text) for r in kept]) if i == c}
    two = FUNCTIONS["n-gram Jaccard join"](spark, one, SF)
    assert two.columns == COLUMNS and sorted(r.doc_id for r in two.collect()) == sorted(first)

    three = FUNCTIONS["PII"](spark, two, SF)
    cleaned = {r.doc_id: r for r in three.collect()}
    assert three.columns == COLUMNS and set(cleaned) == first
    for i, r in cleaned.items():
        if not plain(rows[i].text):
            continue
        assert r.text != rows[i].text and not plain(r.text) and r.n_chars == len(r.text)

    four = FUNCTIONS["mixing sources to target weights"](spark, three, SF)
    assert four.columns == COLUMNS
    wanted = sorted((r.doc_id, r.text) for r in mixing.mix(three).collect())
    assert sorted((r.doc_id, r.text) for r in four.collect()) == wanted

    vocabulary = sentencepiece_viterbi.load_vocabulary(corpus_pipeline.PIECE_MODEL)
    five = FUNCTIONS["SentencePiece encoding and decoding"](spark, four, SF).collect()
    assert sorted((r.doc_id, sentencepiece_viterbi.decode_ids(r.ids, vocabulary["spelled"])) for r in five) == wanted

    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in five)


EDGES = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! ???", "en", "a", 7), (4, "the cat of that house and this one is here", "en", "a", 1), (4, "the cat of that house and this one is here", "en", "a", 1), (None, "the dog of that house and this one is there", None, None, 3), (5, "the and " * 20_000, "en", "b", 5)]


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_each_stage_on_edge_cases(spark, documents, name):
    docs = spark.createDataFrame(EDGES, documents.schema)
    found = FUNCTIONS[name](spark, docs, SF).collect()
    ids = [r.doc_id for r in found]
    if name == "language ID":
        assert sorted(ids, key=str) == sorted([4, 4, 5, None], key=str)
    elif name == "n-gram Jaccard join":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, None], key=str)
    elif name == "PII":
        assert sorted(ids, key=str) == sorted((r[0] for r in EDGES), key=str)
    elif name == "SentencePiece encoding and decoding":
        assert len(ids) == len(EDGES)


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_each_stage_without_rows(spark, documents, name):
    assert FUNCTIONS[name](spark, documents.limit(0), SF).count() == 0


def test_language_stage_keeps_short_and_unlearned_texts(spark, documents):
    texts = ["ok", "日本語", "ж", None, "123", "the cat of that house and this one is here"]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], documents.schema)
    assert sorted(r.doc_id for r in FUNCTIONS["language ID"](spark, docs, SF).collect()) == [0, 1, 2, 5]

"""Shared-prefix segmentation against a plain search, and exact round trips."""

import random
import re
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import sentencepiece_viterbi as sv
from rasterloom.llm.queries import PIECE_MODEL, op10_sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    return sv.load_vocabulary(PIECE_MODEL)


def best_score(text, vocabulary):
    """Of all segmentations of the whole text, by its positions one by one."""
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, vocabulary["ids"]))
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + vocabulary["unknown"] if text[end - 1] not in vocabulary["ids"] else float("-inf")
        for start in range(max(0, end - longest), end):
            score = vocabulary["scores"].get(text[start:end])
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def score_of(ids, vocabulary):
    """The score of ids; byte pieces count once for each character that they spell."""
    bytes_of = {k: b for b, k in enumerate(vocabulary["bytes"])}
    score_by_id = {k: vocabulary["scores"][p] for p, k in vocabulary["ids"].items()}
    return sum(vocabulary["unknown"] * (bytes_of[k] & 0xC0 != 0x80) if k in bytes_of else score_by_id[k] for k in ids)


TEXTS = ["", " ", "a", "hello world", "  two  blanks ", "tab\tand\nlines\n\n", "é 日本語 ж😀 \u2581 x\u2581y", "<s> </s> <unk> <0x41>", "Ünïcödé", "internationalization " * 50, "x" * 5000, "\x00\x7f", "a" + " " * 40 + "b"]


def encode(texts, vocabulary):
    flat, n = sv.Encoder(vocabulary).encode(texts)
    out, at = [], 0
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


def test_best_segmentation_of_whole_texts(vocabulary):
    for text, ids in zip(TEXTS, encode(TEXTS, vocabulary), strict=True):
        if text:
            assert score_of(ids, vocabulary) == pytest.approx(best_score(" " + text, vocabulary)), text
        assert sv.decode_ids(ids, vocabulary["spelled"]) == text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeinrst \né日")), max_size=25), max_size=12))
def test_words_share_prefixes_without_changing_results(vocabulary, texts):
    together = encode(texts, vocabulary)
    assert together == [encode([t], vocabulary)[0] for t in texts]
    for text, ids in zip(texts, together, strict=True):
        assert sv.decode_ids(ids, vocabulary["spelled"]) == text
        if text:
            assert score_of(ids, vocabulary) == pytest.approx(best_score(" " + text, vocabulary))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(vocabulary, text):
    assert sv.decode_ids(encode([text], vocabulary)[0], vocabulary["spelled"]) == text


def test_words_cut_where_no_piece_reaches(vocabulary):
    assert not [p for p in vocabulary["ids"] if re.search(r"[^ ] |\n", p)]
    assert "".join(sv._WORDS.findall(" a  b\n c\n\n d  ")) == " a  b\n c\n\n d  "


def test_library_decodes_our_ids(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in ("hello world", "The quick brown fox, 日本 é!", "a\nb  c"):
        assert sp.decode(encode([text], vocabulary)[0]) == text


def test_forgetting_words(vocabulary, monkeypatch):
    monkeypatch.setattr(sv, "_CACHE_WORDS", 3)
    monkeypatch.setattr(sv, "_CHUNK", 10)
    texts = [f"word{k} again word{k % 4}" for k in range(30)]
    encoder = sv.Encoder(vocabulary)
    flat, n = encoder.encode(texts + texts)
    monkeypatch.undo()
    assert flat.tolist() == [i for ids in encode(texts + texts, vocabulary) for i in ids] and n.sum() == len(flat)


def test_long_words_are_found_the_same_way(vocabulary, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice(["the", "ing", "日", "é", "x", "ation", "7", " "[:0]]) for _ in range(40)) for _ in range(30)]
    wanted = encode(words, vocabulary)
    monkeypatch.setattr(sv, "LONG_WORD", 3)
    assert encode(words, vocabulary) == wanted


def test_a_word_of_a_million_characters_takes_little_memory(vocabulary):
    word = "abcdefgh日" * 120_000
    trie = sv.piece_trie(vocabulary)
    tracemalloc.start()
    ids = sv.encode_words([word], vocabulary, trie)[word]
    assert tracemalloc.get_traced_memory()[1] < 40 * len(word)
    tracemalloc.stop()
    assert sv.decode_ids(ids, vocabulary["spelled"]) == word


def test_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(100, None, "x"), (1, TEXTS[1], "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = sv.encode(docs, PIECE_MODEL)
    assert encoded.columns == ["doc_id", "ids", "n_ids"]
    back = sv.decode(encoded.withColumn("text", F.lit("old")), PIECE_MODEL)
    got = sorted(((r.doc_id, r.text) for r in back.collect()), key=str)
    assert got == sorted(((i, t) for i, t, _ in rows), key=str)
    assert all(r.n_ids == len(r.ids) if r.ids is not None else r.n_ids is None for r in encoded.collect())
    assert sv.encode(docs.limit(0), PIECE_MODEL).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    got = op10_sentencepiece(spark, "/root/testdata/sf0.001")
    assert got.join(docs, "doc_id").where("digest = decoded_sha256").count() == docs.count() == got.count()

"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of its byte 4-grams; the filters are stored bit-sliced, one bit a language in each slot,
so one probe returns all languages that contain an n-gram. The popcounts per language of a text, less the false positives
that the filters' fill predicts, decide.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text when nothing could be
learned. Texts with a letter none of whose n-grams is known get, with score 0, the language to whose bytes theirs are likeliest
to belong, or the most frequent training language where no language has any of their bytes. Ties go to the language that sorts
first. Of more than MOST_LANGUAGES values the rarest teach nothing. Rows are independent: repeated rows get equal results, and
no text sees another's n-grams. Extra columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import IS_SPACE, batches_of, bound_batches, joined, mix

UNDETERMINED = "und"
HASHES = 3
#: Languages at most, the most frequent ones (rarer values of a dirty column teach nothing); a slot has a 64-bit word for each 64.
MOST_LANGUAGES = 1024
#: Bytes of text judged together, at some fifty times as much memory, in each of an executor's Python workers.
_CHUNK = 1 << 18

#: ASCII that isn't a letter becomes a blank; bytes of other characters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def ngrams(texts: list[str | None]):
    """For chunks of the texts: the first index, 4-gram codes, and for each text where its codes begin (and the end)."""
    # a blank before each text, besides the newline after it, so that its first n-gram is its own
    folded = [b" " + (t or "").lower().encode("utf-8", "replace") for t in texts]
    for first, last in batches_of(folded, _CHUNK):
        data, at = joined(folded[first:last])
        data = _FOLD[data]
        if len(data) < 4:
            yield first, np.zeros(0, np.uint32), np.zeros(last - first + 1, np.int64)
            continue
        blank = IS_SPACE[data]
        wide = data.astype(np.uint32)
        codes = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        inner = np.flatnonzero(~(blank[1:-2] | blank[2:-1]))  # two blanks stand between texts, so no n-gram reaches into the next
        yield first, codes[inner], np.searchsorted(inner, at)


def slots(codes: np.ndarray, n_slots: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array a hash function; n_slots is a power of two."""
    h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(n_slots - 1)
    return [((h >> np.uint64(21 * k)) & low).astype(np.int64) for k in range(HASHES)]


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1500, n_slots: int = 1 << 20, share: float = 0.2, least: int = 3) -> dict:
    """Learn the filters from about docs_per_language texts of each language, taken by the hash of the text.

    An n-gram belongs to a language if it was seen there `least` times, at a rate of at least `share` of the highest rate in
    any language: passages quoted from another language then don't put that language's n-grams into the filter.
    The sample's bound is docs_per_language; the driver receives at most n_slots rows.
    """
    if n_slots & (n_slots - 1) or not 1 << 8 <= n_slots <= 1 << 21:
        raise ValueError("n_slots must be a power of two from 2**8 to 2**21")
    bound_batches(train.sparkSession)
    known = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "filter": np.zeros((n_slots, 1), np.uint64), "rates": np.zeros(0), "letters": np.zeros((0, 256)), "usual": -1}
    whole = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(whole, whole * docs_per_language // counts[lang]))])
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(whole)) < rate[F.col("lang")])
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches):
        for batch in batches:
            of = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, codes, at in ngrams(batch.column("text").to_pylist()):
                doc = np.repeat(of[first : first + len(at) - 1], np.diff(at))
                keys, n = np.unique(codes.astype(np.int64) | doc << 32, return_counts=True)
                yield pa.record_batch({"gram": keys & 0xFFFFFFFF, "lang": keys >> 32, "n": n.astype(np.int64)})

    words = (len(langs) + 63) // 64
    counted = sample.mapInArrow(count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # rates are relative to what the sample holds of each language, so they are summed before they are compared
    letters = np.zeros((len(langs), 256))  # n-grams by their second byte, which isn't blank
    for r in counted.groupBy("lang", F.shiftright("gram", 8).bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).collect():
        letters[r.lang, r.byte] = r.n
    per = F.create_map(*[F.lit(x) for k in range(len(langs)) for x in (k, float(letters[k].sum() or 1))])
    seen = counted.withColumn("rate", F.col("n") / per[F.col("lang").cast("int")])
    best = seen.groupBy("gram").agg(F.collect_list(F.struct("lang", "n", "rate")).alias("seen"), F.max("rate").alias("top"))
    members = best.select("gram", F.explode("seen").alias("s"), "top").where((F.col("s.n") >= least) & (F.col("s.rate") >= share * F.col("top"))).select("gram", F.col("s.lang").alias("lang"))

    def place(batches):
        for batch in batches:
            codes, lang = batch.column("gram").to_numpy(), batch.column("lang").to_numpy()
            for where in slots(codes.astype(np.uint32), n_slots):
                yield pa.record_batch({"slot": where, "word": (lang // 64).astype(np.int32), "bits": (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)})

    placed = members.mapInArrow(place, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    filters = np.zeros((n_slots, words), np.uint64)
    filters[placed["slot"].to_numpy(), placed["word"].to_numpy()] = placed["bits"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([((filters[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    usual = max(range(len(langs)), key=lambda k: (counts[langs[k]], -k))
    return {"langs": langs, "filter": filters, "rates": fill**HASHES, "letters": letters, "usual": usual}


def score_texts(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the index of its language (-1: none), its share of the corrected hits, and its known share of n-grams."""
    langs, filters, wrong = model["langs"], model["filter"], model["rates"]
    best, score, cover = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    if not langs:
        return best, score, cover
    for first, codes, at in ngrams(texts):
        n = np.diff(at)
        where = slots(codes, len(filters))
        hits = np.zeros((len(n), len(langs)))
        some = n > 0
        starts = at[:-1][some]
        for word in range(filters.shape[1]):
            mask = filters[where[0], word]
            for w in where[1:]:
                mask &= filters[w, word]
            for k in range(64 * word, min(len(langs), 64 * word + 64)):
                if len(starts):
                    hits[some, k] = np.add.reduceat(((mask >> np.uint64(k - 64 * word)) & np.uint64(1)).astype(np.int32), starts)
        hits = np.maximum(0, (hits - n[:, None] * wrong) / (1 - wrong))
        total, top = hits.sum(axis=1), hits.argmax(axis=1)
        most = hits[np.arange(len(n)), top]
        found = most > 0
        rows = np.arange(first, first + len(n))
        best[rows[found]] = top[found]
        score[rows[found]] = most[found] / total[found]
        cover[rows[found]] = np.minimum(1.0, most[found] / n[found])
    return best, score, cover


def nearest(model: dict, text: str) -> int:
    """The language of a text without a known n-gram: by its single bytes, else the most frequent one (-1: none)."""
    letters = model["letters"]
    data = _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    data = data[~IS_SPACE[data]]
    if not len(letters) or not letters[:, data].any():
        return model["usual"]
    return int(np.log((letters[:, data] + 0.5) / (letters.sum(axis=1, keepdims=True) + 128)).sum(axis=1).argmax())


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred, score and coverage for each row.

    Columns of docs named lang_pred, score or coverage are replaced. score is the best language's share of all corrected
    hits, coverage the share of the text's n-grams that the best language's filter holds. The text goes to Python and three
    small values come back; whatever columns are kept stay in the JVM.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "coverage")]
    shared = spark.sparkContext.broadcast(model)  # n_slots words of 8 bytes a 64 languages, whatever the input

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names_of = np.array([*model["langs"], UNDETERMINED], dtype=object)
        for text in batches:
            best, score, cover = score_texts(model, text.to_pylist())
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(lettered & (best < 0)):
                best[k] = nearest(model, text[int(k)].as_py())
            best, score, cover = np.where(lettered, best, -1), np.where(lettered, score, 0.0), np.where(lettered, cover, 0.0)
            score = np.where(best < 0, 0.0, score)
            yield pa.StructArray.from_arrays([pa.array(names_of[best], pa.string()), pa.array(score), pa.array(cover)], ["lang_pred", "score", "coverage"])

    # not deterministic by declaration only: a filter on the verdict would else have every text judged twice
    judge = F.arrow_udf(predict, "lang_pred string, score double, coverage double").asNondeterministic()
    judged = docs.select(*names, judge(F.col(text_col)).alias("language verdict"))
    return judged.select(*names, *[F.col(f"`language verdict`.{c}").alias(c) for c in ("lang_pred", "score", "coverage")])

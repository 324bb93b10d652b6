"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import chat_format, gif, language_id, lm_scoring, mixing, ngram_join, pii, quality_outliers, sentencepiece_viterbi, url_filter
from rasterloom.llm.common import table

#: A public SentencePiece vocabulary; never copied into the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def trains_lang(id_col: str = "doc_id"):
    """Rows from which language ID may learn; a null id may."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Fixed words of hosts and paths that a reader would block or allow, and the urls that are made of them.
BLOCKED_WORDS = "casino poker jackpot bets slots lottery pills pharmacy viagra adult porn xxx dating spam clickbait malware phishing ads adserver track tracker popup torrent replica loans".split()
ALLOWED_WORDS = "news blog wiki docs library school university museum city garden music weather science history recipes travel sport forum health law family books maps mail shop".split()
URL_FORMS = ("http://{0}.example.com/en/{1}", "https://www.{0}-{2}.example.org/{1}.html", "http://{2}-{0}.example.com/fr/{1}?page=2", "https://m.{0}-{2}.example.net/de/{1}/", "https://{2}.example.org/{0}/{1}", "http://{0}{2}.example.info/{1}#top")
#: Syllables of made-up names, which are to be allowed: an unknown host is no reason to block.
SYLLABLES = "the and ing ion ent for tha ter ers est".split()
BESIDES = {0: ("home", "online", "local", "open"), 1: ("win", "free", "cheap", "farm", "best", "x")}


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: each word in each form and made-up names in some, with numbers that say nothing."""
    rows = []
    for block, words in ((0, ALLOWED_WORDS), (1, BLOCKED_WORDS)):
        for k, word in enumerate(words):
            rows += [(form.format(word, 1000 + 37 * (6 * k + j) % 8999, BESIDES[block][(k + j) % len(BESIDES[block])]), block) for j, form in enumerate(URL_FORMS)]
    made_up = [a + b for a in SYLLABLES for b in SYLLABLES if a != b]
    rows += [(form.format(word, 1000 + 53 * (3 * k + j) % 8999, "www"), 0) for k, word in enumerate(made_up) for j, form in enumerate(URL_FORMS[k % 2 :: 2])]
    return spark.createDataFrame(rows, "url string, block int")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that no rule fits are judged by a model trained on a small labelled table, which the rules have no part in."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(labelled_urls(spark))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "probability")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(trains_lang()))
    out = language_id.identify(docs.select("doc_id", "text").withColumn("held_out", ~trains_lang()), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.inspect(gif.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to equal weights, as many rows expected as there are."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


#: The fixed conversation that op9 formats besides the table's: control strings in its texts.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat_format.digest(chat_format.expand(turns.unionByName(probe)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of the text that they decode to."""
    encoded = sentencepiece_viterbi.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    decoded = sentencepiece_viterbi.decode(encoded.withColumn("read", F.col("ids")), PIECE_MODEL, ids_col="read", text_col="decoded")
    return decoded.select("doc_id", "n_ids", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_url_filter, op3_ngram_join, op4_language_id, op5_gif, op6_quality_outliers, op7_mixing, op8_pii, op9_chat_format, op10_sentencepiece)}
ORACLE_SQL: dict[str, str] = {
    "op9_chat_format": chat_format.DIGEST_SQL.format(probe=PROBE_ID, text=PROBE_TEXT),
    "op7_mixing": mixing.MIX_SQL.format(docs="documents", columns="doc_id, text, lang, source, n_chars"),
}

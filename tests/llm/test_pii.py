"""Personal data: base spans against a plain scan, planted cases, model behaviour and redaction."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pii

SCHEMA = "doc_id long, text string"
SCAN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text: str | None) -> list[tuple[int, int, int]]:
    found = []
    for rank, (kind, pattern) in enumerate(SCAN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


TEXTS = [
    None,
    "",
    "nothing here",
    "a@b.cc_x@y.z and a.b+c@d-e.f.g. 1.2.3.4.5.6.7.8 999.1.1.1 01.002.0255.3 1.2.3",
    "é😀 x@y.zz 4532015112830366 4532-0151-1283-0366 4532 0151 1283 0367 0 1 2 3 4 5 6 7 8 9",
    "+1 (988) 555-2485, +1..2 +49 30 901820 +123456789012345678 ++1 555 555 5555 +1 (555) 555-5555-",
    "@ @@ a@b a@b. a@.b a@b..c _@-.- x@y.z@w.v x@y.z%q@r.s",
    "7" * 5000 + " " + "1 " * 5000 + "a" * 5000 + "@" + "b." * 5000,
    "call me at (555) 123-4567 or phone 555-123-4567, ssn 123-45-6789; jo [at] host [dot] org",
    "1.1.1.1\n255.255.255.255\t256.1.1.1 4532015112830366\n4532015112830366",
]


def rows_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])], SCHEMA)


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{list(SCAN)[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_base_spans_equal_a_plain_scan(spark):
    docs = rows_of(spark)
    got = pii.find(docs.withColumn("spans", F.lit(1)), pii.fit(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        spans = plain(TEXTS[4 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == digest(spans), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        written = set(r.spans.split(","))
        assert all(f"{list(SCAN)[k]}:{s}:{e}" in written for s, k, e in spans)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs, pii.fit(docs)).collect():
        assert r.base_sha256 == digest(plain(texts[r.doc_id]))


def test_empty_table_and_no_candidates(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii.fit(docs) == {} and pii.find(docs, {}).count() == 0
    assert pii.find(spark.createDataFrame([(1, "a@b.cc")], SCHEMA), {}).first().n_email == 1


def plain_posterior(rows, rounds=400):
    """The mixture by loops: two classes, each labeler's votes independent in a class, pseudo-counts by the stated prior."""
    total = sum(n for _, n in rows)
    strength = pii.PRIOR_ROWS + pii.PRIOR_SHARE * total
    abstain = [sum(n for v, n in rows if v[j] == 1) / total for j in range(4)]

    def believed(y, j, vote):
        err = pii.ERRS[pii.LABELERS[j]]
        return abstain[j] if vote == 1 else (1 - abstain[j]) * (1 - err if (vote == 2) == (y == 0) else err)

    rate = {(y, j, v): believed(y, j, v) for y in (0, 1) for j in range(4) for v in range(3)}
    share = 0.5
    for _ in range(rounds):
        post = []
        for v, _ in rows:
            yes, no = share, 1 - share
            for j in range(4):
                yes *= rate[0, j, v[j]] + 1e-9
                no *= rate[1, j, v[j]] + 1e-9
            post.append(yes / (yes + no))
        mass = [sum(n * p for (_, n), p in zip(rows, post)), sum(n * (1 - p) for (_, n), p in zip(rows, post))]
        share = (mass[0] + pii.PRIOR_ROWS / 2) / (total + pii.PRIOR_ROWS)
        rate = {(y, j, v): (sum(n * (p if y == 0 else 1 - p) for (w, n), p in zip(rows, post) if w[j] == v) + strength * believed(y, j, v)) / (mass[y] + strength) for y, j, v in rate}
    return {v: p for (v, _), p in zip(rows, post)}


VOTES = [((2, 2, 2, 2), 900), ((1, 1, 2, 2), 60), ((0, 0, 1, 0), 800), ((0, 2, 1, 2), 90), ((2, 0, 1, 0), 7), ((1, 2, 1, 0), 33)]


def test_estimation_equals_a_plain_one():
    got, wanted = pii.estimate([("phone", v, n) for v, n in VOTES])["phone"], plain_posterior(VOTES)
    assert all(abs(got[v] - wanted[v]) < 1e-5 for v, _ in VOTES), (got, wanted)
    assert got[2, 2, 2, 2] > 0.9 and got[0, 0, 1, 0] < 0.1


def test_the_classifier_sees_more_than_votes():
    """Two groups of candidates with the same unsure votes: what they look like tells them apart, by the votes of others that look so."""
    good, bad, unsure = (2, 2, 2, 2), (0, 0, 1, 0), (1, 1, 1, 1)
    seen = [("phone", (*good, 2, 2, 1, 1, 2), 500), ("phone", (*bad, 4, 4, 3, 3, 0), 500), ("phone", (*unsure, 2, 2, 1, 1, 0), 50), ("phone", (*unsure, 4, 4, 3, 3, 0), 50)]
    posterior = pii.estimate([("phone", good, 500), ("phone", bad, 500), ("phone", unsure, 100)])["phone"]
    bias, of = pii.train(seen, {"phone": posterior})["phone"]
    score = lambda x: bias + sum(of[n][v] for n, v in zip(pii.FEATURES, x, strict=True))
    assert score(seen[0][1]) > 0 > score(seen[1][1])
    assert score(seen[2][1]) > score(seen[3][1])


def redacted(text, spans):
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out.append(text[at:s] + f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def test_redaction_writes_what_the_spans_say(spark):
    long = "é😀" * 700 + " a@b.cc " + "x" * 2000 + " 1.2.3.4 +1 (988) 555-2485 190.1.2.3 " + "y" * 511 + " b@c.dd"
    docs = spark.createDataFrame([*enumerate(TEXTS), (90, long), (91, long * 3)], SCHEMA)
    model = pii.fit(docs)
    found = {r.doc_id: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.find(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.redact(docs, model).collect():
        text = texts[r.doc_id]
        assert r.text == (text and redacted(text, found[r.doc_id])), r.doc_id
    assert len(found[91]) >= 12


def cpu_seconds(spark):
    """CPU time of Spark's JVM, which what else runs on the machine doesn't lengthen."""
    with open(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/stat") as stat:
        fields = stat.read().rpartition(")")[2].split()
    return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")


@pytest.mark.parametrize("word", ["12, ", "a@b.cc ", "1.2.3.4 "])
def test_cost_follows_the_length_of_a_text(spark, word):
    """Many matches in one text: four times the text costs about four times as much, and 100,000 matches a matter of seconds."""
    docs = spark.createDataFrame([(1, "a@b.cc 1.2.3.4")], SCHEMA)
    model = pii.fit(docs)
    took = {}
    for n in (1_000, 25_000, 100_000):  # the first is for compiling
        text = spark.createDataFrame([(1, word * n)], SCHEMA)
        began = cpu_seconds(spark)
        row = pii.find(text, model).first()
        clean = pii.redact(text, model).first().text
        took[n] = cpu_seconds(spark) - began
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (n * (word[0] == "a"), n * (word[1] == "."), 0, 0)
        assert clean == {"a": "[EMAIL] ", "1": "[IP] " if word[1] == "." else word}[word[0]] * n
    assert took[100_000] < 60 and took[100_000] < 8 * took[25_000] + 4, took


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "x"), (2, None, None), (3, "1.2.3.4 and 1.2.3.4", "y"), (4, "é plain", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.redact(docs, {}).collect()}
    assert got == {1: ("mail [EMAIL] now", "x"), 2: (None, None), 3: ("[IP] and [IP]", "y"), 4: ("é plain", "z")}

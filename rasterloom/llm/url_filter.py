"""URL filters: list rules, and logistic regression on hashed character n-grams of host and path.

A rule (host, path prefix) fits its host and all subdomains if the url's path starts with the prefix; the longest fitting rule
decides (between equally long ones, the one that sorts first). Urls that no rule fits are judged by the model.
The model has one weight for each of 2**BITS buckets; n-grams of SIZES bytes of host and path fall into buckets by hash, host
and path apart, each counting once per url, scaled to unit length. It is trained on the driver from a labelled table of at most
MOST_LABELLED urls by full-batch gradient steps with per-weight rates, so training is deterministic.

Defined results: a null url, or one without `://`, has empty host and path, and is judged by the model's bias alone. N-grams
with U+0000 or a line feed don't count. Rows are independent; extra columns are kept by `judge`, apart from those it adds (host, path, rule, verdict, probability).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import UPPER, batches_of, joined, mix

BITS, SIZES, MOST_LABELLED = 18, (2, 3, 4, 5), 4000
ALLOW, BLOCK = "allow", "block"
_CHUNK = 1 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that decides, as written, and its verdict; nulls if none fits. rules: (verdict, `host/path prefix`)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last condition that is added is the first that is tested
    for ruled, written in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, prefix = written.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(written)).otherwise(rule), F.when(fits, F.lit(ruled)).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str]):
    """For chunks of urls: first index, bucket of each distinct n-gram of each url, and where each url begins (and the end)."""
    texts = [f"{h}\x00{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths, strict=True)]
    host_bytes = np.fromiter((len(h.encode("utf-8", "surrogatepass")) for h in hosts), np.int64, len(hosts))
    for first, last in batches_of(texts, _CHUNK):
        data, at = joined(texts[first:last])
        wide = data.astype(np.uint64)
        owner = np.repeat(np.arange(last - first), np.diff(at))
        in_path = np.arange(len(data)) > (at[:-1] + host_bytes[first:last])[owner]  # past the zero byte after the host
        keys = []
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                continue
            gram, same = np.zeros(n, np.uint64), np.ones(n, bool)
            for k in range(size):
                gram = gram << np.uint64(8) | wide[k : n + k]
                same &= (data[k : n + k] != 0) & (data[k : n + k] != 10)
            gram = gram << np.uint64(4) | np.uint64(size) | in_path[:n].astype(np.uint64) << np.uint64(3)
            bucket = mix(gram) & np.uint64((1 << BITS) - 1)
            keys.append((owner[:n].astype(np.uint64)[same] << np.uint64(BITS)) | bucket[same])
        distinct = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        begins = np.searchsorted(distinct, np.arange(last - first + 1, dtype=np.uint64) << np.uint64(BITS))
        yield first, (distinct & np.uint64((1 << BITS) - 1)).astype(np.int64), begins


def probabilities(model: dict, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability that each url is to be blocked."""
    z = np.full(len(hosts), model["bias"])
    for first, bucket, at in features(hosts, paths):
        n = np.diff(at)
        total = np.concatenate(([0.0], np.cumsum(model["weights"][bucket])))
        z[first : first + len(n)] += (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(n, 1))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "block", rounds: int = 150, rate: float = 0.5, penalty: float = 1e-5) -> dict:
    """Weights from urls labelled 1 (block) or 0; rows with a null label are left out, and no rows give a model that allows all."""
    host, path = split_url(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("y")).orderBy("host", "path", "y").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    weights, bias = np.zeros(1 << BITS), -4.0
    y = np.array([r.y for r in rows])
    if not len(rows) or not 0 < y.mean() < 1:
        return {"weights": weights, "bias": 4.0 if len(rows) and y.mean() == 1 else bias}
    buckets, begins = [], [np.zeros(1, np.int64)]
    for _, bucket, at in features([r.host for r in rows], [r.path for r in rows]):
        begins.append(at[1:] + begins[-1][-1])
        buckets.append(bucket)
    bucket, at = np.concatenate(buckets), np.concatenate(begins)
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    value = 1 / np.sqrt(np.maximum(np.diff(at), 1))[owner]
    bias, seen, seen_bias = 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, weights[bucket] * value, len(rows)) + bias
        off = (1 / (1 + np.exp(-z)) - y) / len(rows)
        slope = np.bincount(bucket, off[owner] * value, 1 << BITS) + penalty * weights
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += off.sum() ** 2
        bias -= rate * off.sum() / np.sqrt(seen_bias)
    return {"weights": weights, "bias": float(bias)}


def judge(pages: DataFrame, model: dict, rules: list[tuple[str, str]], *, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits), verdict and the model's probability of blocking."""
    added = ("host", "path", "rule", "verdict", "probability")
    names = [c for c in pages.columns if c not in added]
    host, path = split_url(F.col(url_col))
    rows = pages.select(*names, host.alias("host"), path.alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    schema = rows.select("*").schema.add("probability", "double")

    def predict(batches):
        for batch in batches:
            hosts, paths = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities(shared.value, hosts, paths))], [*batch.schema.names, "probability"])

    scored = rows.mapInArrow(predict, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(*names, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("probability") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "probability")


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url", rows: int = 2000) -> DataFrame:
    """A small labelled table: the `rows` distinct urls of least hash among those that a rule decides."""
    host, path = split_url(F.col(url_col))
    ruled = pages.select(F.col(url_col).alias("url"), rule_of(host, path, rules)[1].alias("verdict")).where("verdict is not null")
    return ruled.distinct().orderBy(F.xxhash64("url"), "url").limit(rows).select("url", (F.col("verdict") == BLOCK).cast("int").alias("block"))

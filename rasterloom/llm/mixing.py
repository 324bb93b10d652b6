"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each row's count inverts the Poisson distribution whose mean is its source's repetition rate,
    rate = weight / sum of weights * rows wanted / rows of the source,
at a uniform number hashed from the seed and the row's id; the row is exploded into that many copies, and the copies are
shuffled globally: dealt out by the hash of (seed, id, copy), with partitions that get too many rows of one place split, and
sorted by it within partitions. The table of rates is written once, and broadcast only up to BROADCAST_BYTES by its own size.

Defined results: a null source is a source of its own; rows with one id (repeated rows, null ids) get one count; a weight of
0 gives no copies; an empty table gives an empty table. Sources without a stated weight get `default_weight`.
The result has all columns of the input, then copy (int, from 1) and place (string); input columns of those names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import let, materialize, running

#: Bytes up to which the table of rates is broadcast; beyond it the join shuffles, and skewed sources are split by AQE.
BROADCAST_BYTES = 8 << 20


def rates(docs: DataFrame, *, source_col: str, weights: dict | None = None, default_weight: float = 1.0, rows_wanted: int | None = None) -> DataFrame:
    """source, rate, first (the least count with any chance) and cdf (of first, first + 1, ...), a row for each source."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("rows").alias("all"), F.sum("weight").alias("of"))
    wanted = F.lit(rows_wanted) if rows_wanted is not None else F.col("all")
    rated = counts.crossJoin(F.broadcast(sums)).select("source", F.coalesce(F.try_divide(F.col("weight") * wanted, F.col("of") * F.col("rows")), F.lit(0.0)).alias("rate"))
    spread = 12 * F.sqrt("rate") + 30
    rated = rated.withColumn("first", F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long")).withColumn("last", F.ceil(F.col("rate") + spread).cast("long"))
    k = F.col("first").cast("double")
    stirling = k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)
    start = F.when(F.col("first") == 0, F.exp(-F.col("rate"))).otherwise(F.exp(k * F.log("rate") - F.col("rate") - stirling))
    rated = rated.withColumn("start", start)
    # P(first), then the factors from each count to the next: their running products are the probabilities
    factors = F.concat(F.array("start"), F.transform(F.sequence(F.col("first") + 1, F.col("last")), lambda j: F.col("rate") / j))
    cdf = let(running(factors, lambda a, b: a * b), lambda p: running(p, lambda a, b: a + b))
    return rated.select("source", "rate", "first", cdf.alias("cdf"))


def uniform(seed: int, id_col):
    """In [0, 1), from the first 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, default_weight: float = 1.0, rows_wanted: int | None = None, seed: int = 42) -> DataFrame:
    names = [c for c in docs.columns if c not in ("copy", "place")]
    table = materialize(rates(docs, source_col=source_col, weights=weights, default_weight=default_weight, rows_wanted=rows_wanted), "mixing-rates")
    size = table.agg(F.coalesce(F.sum(64 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 8 * F.size("cdf")), F.lit(0))).first()[0]
    table = table.select(F.struct(*table.columns).alias("rate of source"))
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rated = docs.select(*names).join(table, F.col(source_col).eqNullSafe(F.col("rate of source.source")))
    drawn = uniform(seed, F.col(id_col))
    rated = rated.withColumn("drawn for mix", drawn)
    copies = F.col("rate of source.first") + F.size(F.filter("rate of source.cdf", lambda c: c <= F.col("drawn for mix")))
    copies = F.when(F.col("rate of source.rate") > 0, copies).otherwise(F.lit(0)).cast("int")
    spread = rated.select(*names, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias("copy"))
    place = F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    # rows of one id and copy have one place; AQE splits the partition that many of them would fill
    return spread.withColumn("place", place).hint("rebalance", "place").sortWithinPartitions("place")


#: The same in DuckDB SQL, for equal weights and seed 42.
MIX_SQL = """
WITH counted AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rated AS (SELECT source, (SELECT sum(n) FROM counted)::DOUBLE / ((SELECT count(*) FROM counted) * n) AS rate FROM counted),
steps AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM rated),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
drawn AS (SELECT *, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {docs}),
numbered AS (SELECT *, row_number() OVER () AS r FROM drawn),
counts AS (SELECT r, count(*) AS copies FROM numbered d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.p <= d.u GROUP BY r)
SELECT {columns}, copy, md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS place
FROM (SELECT d.*, unnest(generate_series(1, c.copies))::INT AS copy FROM numbered d JOIN counts c USING (r))
"""

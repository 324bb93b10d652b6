"""Images, signals and a page made of the supplied tables by formulas that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr("'orders' AS image_id", "cast(o_orderkey div 100 AS int) AS y", "cast(o_orderkey % 100 AS int) AS x", "cast(floor(o_totalprice) % 256 AS smallint) AS v")


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr("'events' AS image_id", "cast(event_id div 100 AS int) AS y", "cast(event_id % 100 AS int) AS x", "cast(least(255, round(value)) AS smallint) AS v")


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.selectExpr("cast(vec_id AS string) AS image_id", "cast(i div 8 AS int) AS y", "i % 8 AS x", "cast(least(255, greatest(0, round((cast(e AS double) + 0.6) * 212.5))) AS smallint) AS v")


def embedding_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("signal_id"), F.posexplode("embedding").alias("idx", "e")).select("signal_id", "idx", F.col("e").cast("double").alias("value"))


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "(x div 30 + y div 30) % 3"
    shown = f"CASE WHEN {cell} = 0 THEN 255 WHEN {cell} = 1 THEN CASE WHEN y % 10 < 3 AND v < 160 THEN 0 ELSE 255 END ELSE v END"
    return orders_raster(spark, sf_dir).selectExpr("'scan' AS image_id", "y", "x", f"cast({shown} AS smallint) AS v")


ORDERS = "(SELECT 'orders' AS image_id, (o_orderkey // 100)::INT AS y, (o_orderkey % 100)::INT AS x, (floor(o_totalprice)::BIGINT % 256)::INT AS v FROM orders)"
EVENTS = "(SELECT 'events' AS image_id, (event_id // 100)::INT AS y, (event_id % 100)::INT AS x, least(255, round(value))::INT AS v FROM events)"
_EXPLODED = "(SELECT vec_id::VARCHAR AS id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)"
TILES = f"(SELECT id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, least(255, greatest(0, round((e + 0.6) * 212.5)))::INT AS v FROM {_EXPLODED})"
SIGNALS = f"(SELECT id AS signal_id, i::INT AS idx, e AS value FROM {_EXPLODED})"
SCAN = f"""(SELECT 'scan' AS image_id, y, x, CASE (x // 30 + y // 30) % 3 WHEN 0 THEN 255 WHEN 1 THEN CASE WHEN y % 10 < 3 AND v < 160 THEN 0 ELSE 255 END ELSE v END AS v FROM {ORDERS})"""

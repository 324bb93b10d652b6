"""Named queries of the JSON documents, the composite reports, and files written and read again, with the SQL of the same."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.operators import blocks, components, cooccurrence, filters, fourier, quality, statistics
from rasterloom.operators.frames import PIXELS_RGB, map_rows, to_images, to_pixels
from rasterloom.plans import experiments
from rasterloom.plans.catalog import BOX_SUM, FULL_3, LABEL_SQL, MERGE_SQL, OTSU_SQL, PAGE, REGION_SQL, SORTED, STATS, STATS_SQL, aperture_cells, glcm_sql, kernel_cells, pixel, query, rotation_sql, rounded, windows_sql
from rasterloom.plans.rasters import ORDERS, SCAN, SIGNALS, TILES, document_scan, embedding_signals, embedding_tiles, orders_raster
from rasterloom.sources import documents, formats, readers, sinks
from rasterloom.sources.documents import documents as written, fixed, significant

LF = "chr(10)"


def text_sql(value: str) -> str:
    """A JSON string, as an SQL expression."""
    return "'" + f'"{value}"'.replace("'", "''") + "'"


def fixed_sql(expression: str, digits: int) -> str:
    return f"(CASE WHEN isinf(({expression})::DOUBLE) THEN '\"inf\"' ELSE printf('%.{digits}f', ({expression})::DOUBLE) END)"


def object_sql(fields: dict, depth: int = 0) -> str:
    """An SQL expression of the laid-out object; a field is an expression of text, or a nested dict."""
    inner = "  " * (depth + 1)
    parts = [f"'{inner}\"{k}\": ' || {object_sql(v, depth + 1) if isinstance(v, dict) else f'({v})'}" for k, v in fields.items()]
    return f"('{{' || {LF} || " + f" || ',' || {LF} || ".join(parts) + f" || {LF} || '{'  ' * depth}}}')"


def document_sql(fields: dict) -> str:
    return object_sql(fields) + f" || {LF}"


def list_sql(item: str, order: str, depth: int = 1, where: str = "") -> str:
    """An aggregate of objects over several lines."""
    kept = f" FILTER ({where})" if where else ""
    inner = "  " * (depth + 1)
    return f"'[' || {LF} || coalesce(string_agg('{inner}' || {item}, ',' || {LF} ORDER BY {order}){kept} || {LF}, '') || '{'  ' * depth}]'"


def columns(*names: str, digits: int | None = None) -> dict:
    return {n: f"{n}::VARCHAR" if digits is None else fixed_sql(n, digits) for n in names}


SIZE_TILES = {"width": "'8'", "height": "'8'"}


# documents

STATS_DOCUMENT = {"input": "'\"' || a.image_id || '\"'", "width": "w::VARCHAR", "height": "h::VARCHAR", "channels": "'1'", "pixel_type": text_sql("uint8"), **columns("mean", "variance", digits=10), "quartiles": columns("q1", "q2", "q3", digits=10),
    **columns("entropy", "energy", "skewness", "kurtosis", digits=10), "histogram": "'[' || histogram || ']'"}


@query(
    f"""SELECT a.image_id, {document_sql(STATS_DOCUMENT)} AS json FROM ({STATS_SQL.format(raster=ORDERS)}) a, (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {ORDERS}),
    (SELECT string_agg(n::VARCHAR, ', ' ORDER BY bin) AS histogram FROM (SELECT b.bin, count(p.v) AS n FROM range(256) b(bin) LEFT JOIN {ORDERS} p ON p.v = b.bin GROUP BY 1))"""
)
def stats_json(spark, d):
    """The statistics document with the 256 counts; figures at 6 decimals, so that no order of adding shows."""
    raster = orders_raster(spark, d)
    counts = statistics.histogram(raster)
    listed = counts.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "cnt"))), lambda x: x["cnt"]).alias("histogram"))
    sized = raster.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return written(rounded(statistics.from_histogram(counts), *STATS).join(listed, "image_id").join(sized, "image_id"), documents.statistics_layout, fixed(10))


GLCM_DOCUMENT = {"input": text_sql("orders"), "width": "w::VARCHAR", "height": "h::VARCHAR", "row_offset": "'0'", "column_offset": "'1'", "total_pairs": "total::VARCHAR", "energy": fixed_sql("round(energy, 9)", 12), "matrix": "matrix"}


@query(
    f"""WITH g AS ({glcm_sql(ORDERS, 0, 1)}), line AS (SELECT a.a, '    [' || string_agg(coalesce(g.cnt, 0)::VARCHAR, ', ' ORDER BY b.b) || ']' AS line FROM range(256) a(a), range(256) b(b) LEFT JOIN g ON g.first = a.a AND g.second = b.b GROUP BY 1)
    SELECT 'orders' AS image_id, {document_sql(GLCM_DOCUMENT)} AS json FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {ORDERS}), (SELECT sum(cnt)::BIGINT AS total, sum(cnt::DOUBLE * cnt) / sum(cnt) / sum(cnt) AS energy FROM g),
    (SELECT '[' || {LF} || string_agg(line, ',' || {LF} ORDER BY a) || {LF} || '  ]' AS matrix FROM line)"""
)
def glcm_json(spark, d):
    images = to_images(orders_raster(spark, d))
    glcm = cooccurrence.cooccurrence_of_images(images, 0, 1)
    cells = glcm.groupBy("image_id").agg(F.collect_list(F.struct("first", "second", "cnt")).alias("pairs"))
    return written(images.select("image_id", "width", "height").join(rounded(cooccurrence.energy(glcm), "energy", digits=9), "image_id").join(cells, "image_id"), documents.cooccurrence_layout, fixed(12))


@query(
    f"""WITH t AS (SELECT image_id, v, CASE WHEN v > 127 THEN 255 ELSE v END AS w FROM {TILES}), q AS (SELECT image_id, avg((v - w) * (v - w)) AS m FROM t GROUP BY 1),
    r AS (SELECT image_id, round(m, 6) AS mse, round(CASE WHEN m = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(255 / sqrt(m)) END, 6) AS psnr_db FROM q)
    SELECT image_id, {document_sql({"original": "'\"' || image_id || '\"'", "distorted": "'\"' || image_id || '\"'", **SIZE_TILES, **columns("mse", "psnr_db", digits=12)})} AS json FROM r"""
)
def quality_json(spark, d):
    """Tiles against themselves with bright pixels white: equal ones have an infinite ratio, written as a string."""
    tiles = embedding_tiles(spark, d)
    white = tiles.withColumn("v", F.when(F.col("v") > 127, 255).otherwise(F.col("v")).cast("smallint"))
    return written(rounded(quality.quality_of_images(to_images(tiles), to_images(white)), "mse", "psnr_db"), documents.quality_layout(), fixed(12))


def checked(plane: np.ndarray) -> np.ndarray:
    """Noise by a formula that SQL can state, for the reports: -20 to 20 by place."""
    y, x = np.indices(plane.shape)
    return np.clip(plane.astype(int) + (y * 31 + x * 17) % 41 - 20, 0, 255).astype(np.uint8)


NOISY = f"(SELECT image_id, y, x, v AS was, least(255, greatest(0, v + (y * 31 + x * 17) % 41 - 20))::INT AS v FROM {ORDERS})"
SMOOTH = windows_sql(NOISY, BOX_SUM, 3, 3, pixel("sum(p.v * k.w) / 9") + " AS v")
MEDIAN = windows_sql(NOISY, aperture_cells(FULL_3), 3, 3, f"({SORTED})[5] AS v")
TRIMMED = windows_sql(NOISY, aperture_cells(FULL_3), 3, 3, pixel(f"list_sum(({SORTED})[3:7]) / 5") + " AS v")


def scores_sql(made: dict[str, str]) -> str:
    """A row of sizes and scores: the original at (y + 1, x + 1) against the noisy one and what each SELECT made of it."""
    joins = " ".join(f"JOIN ({sql}) {n} ON {n}.image_id = p.image_id AND {n}.y = p.y - 1 AND {n}.x = p.x - 1" for n, sql in made.items())
    mse = ", ".join(f"avg((p.was - {c}) * (p.was - {c})) AS {n}_m" for n, c in [("noisy", "p.v"), *((n, f"{n}.v") for n in made)])
    out = ", ".join(f"round({n}_m, 6) AS {n}_mse, round(20 * log10(255 / sqrt({n}_m)), 6) AS {n}_psnr_db" for n in ("noisy", *made))
    return f"""SELECT image_id, original_width, original_height, width, height, {out} FROM (SELECT p.image_id, (max(p.x) + 2)::INT AS original_width, (max(p.y) + 2)::INT AS original_height, max(p.x)::INT AS width, max(p.y)::INT AS height, {mse}
      FROM {NOISY} p {joins} GROUP BY 1)"""


KEPT = f"SELECT s.image_id, s.y, s.x, CASE WHEN abs(s.v - n.v) >= 6 THEN s.v ELSE n.v END AS v FROM ({SMOOTH}) s JOIN {NOISY} n ON n.image_id = s.image_id AND n.y = s.y + 1 AND n.x = s.x + 1"
LOW_PASS_SCORES = scores_sql({"filtered": SMOOTH})
KEPT_SCORES = scores_sql({"filtered": KEPT})
RANK_SCORES = scores_sql({"median": MEDIAN, "trimmed_mean": TRIMMED})


def _scores(found):
    return rounded(found, *[c for c in found.columns if c.endswith(("_mse", "_psnr_db"))])


@query(LOW_PASS_SCORES)
def low_pass_report(spark, d):
    return _scores(experiments.low_pass_scores(to_images(orders_raster(spark, d)), checked, 3))


@query(KEPT_SCORES)
def threshold_low_pass_report(spark, d):
    return _scores(experiments.low_pass_scores(to_images(orders_raster(spark, d)), checked, 3, 6.0))


@query(RANK_SCORES)
def rank_report(spark, d):
    return _scores(experiments.rank_scores(to_images(orders_raster(spark, d)), checked, FULL_3, 4))


def _compared(what: str) -> dict:
    sizes = {"original_width": "original_width::VARCHAR", "original_height": "original_height::VARCHAR", "comparison_width": "width::VARCHAR", "comparison_height": "height::VARCHAR"}
    return sizes | {"comparison_method": text_sql(f"center crop original and noisy images to the valid {what} result size")}


HEAD = {"input": text_sql("orders"), "noisy_output": text_sql("n.png"), "filtered_output": text_sql("f.png"), "noise_type": text_sql("gaussian"), "variance": "'140.000000000000'", "seed": "'1'"}
LOW_PASS_FIELDS = {**HEAD, "filter": {"type": text_sql("average_low_pass"), "kernel_width": "'3'", "kernel_height": "'3'"}, **_compared("convolution"), **columns("noisy_mse", "noisy_psnr_db", "filtered_mse", "filtered_psnr_db", digits=12)}
KEPT_FIELDS = {**LOW_PASS_FIELDS, "filter": {"type": text_sql("thresholded_average_low_pass"), "kernel_width": "'3'", "kernel_height": "'3'", "threshold": "'6.000000000000'"}}


@query(f"SELECT image_id, {document_sql(LOW_PASS_FIELDS)} AS json FROM ({LOW_PASS_SCORES})")
def low_pass_json(spark, d):
    return written(low_pass_report(spark, d), documents.low_pass_layout("gaussian", 140.0, 1, 3, None, noisy="n.png", filtered="f.png"), fixed(12))


@query(f"SELECT image_id, {document_sql(KEPT_FIELDS)} AS json FROM ({KEPT_SCORES})")
def threshold_low_pass_json(spark, d):
    return written(threshold_low_pass_report(spark, d), documents.low_pass_layout("gaussian", 140.0, 1, 3, 6.0, noisy="n.png", filtered="f.png"), fixed(12))


RANK_FIELDS = {"input": text_sql("orders"), "noisy_output": text_sql("n.png"), "median_output": text_sql("m.png"), "trimmed_mean_output": text_sql("t.png"), "noise_type": text_sql("impulse"), "probability": "'0.050000000000'", "seed": "'1'",
    "aperture": {"width": "'3'", "height": "'3'", "active_cells": "'9'"}, "median_filter": {"rank": "'4'"}, "trimmed_mean_filter": {"trimmed_count": "'4'", "trim_each_side": "'2'"}, **_compared("aperture"),
    **columns("noisy_mse", "noisy_psnr_db", "median_mse", "median_psnr_db", "trimmed_mean_mse", "trimmed_mean_psnr_db", digits=12)}


@query(f"SELECT image_id, {document_sql(RANK_FIELDS)} AS json FROM ({RANK_SCORES})")
def rank_json(spark, d):
    return written(rank_report(spark, d), documents.rank_layout("impulse", 0.05, 1, FULL_3, 4, noisy="n.png", median="m.png", trimmed_mean="t.png"), fixed(12))


LOG_5 = kernels.laplacian_of_gaussian(5, 1.0)
CROSSING_SQL = f"""WITH r AS ({windows_sql(TILES, kernel_cells(LOG_5), 5, 5, 'sum(p.v * k.w) AS r')}), t AS (SELECT image_id, 3 * sum(abs(r)) / (4 * count(*)) AS t FROM r GROUP BY 1),
    n AS (SELECT r.*, t.t, lag(r) OVER a AS w, lead(r) OVER a AS e, lag(r) OVER b AS n, lead(r) OVER b AS s FROM r JOIN t USING (image_id) WINDOW a AS (PARTITION BY r.image_id, y ORDER BY x), b AS (PARTITION BY r.image_id, x ORDER BY y)),
    z AS (SELECT image_id, round(max(t), 6) AS threshold, count(*) FILTER ({' OR '.join(f'(sign(r) * sign({k}) < 0 AND abs(r - {k}) >= t)' for k in 'wens')}) AS edge_pixels FROM n GROUP BY 1)
"""
CROSSING_FIELDS = {"input": "'\"' || image_id || '\"'", "edge_output": text_sql("e.png"), "method": text_sql("LoG zero crossing"), "kernel_width": "'5'", "kernel_height": "'5'", "sigma": "'1.000000000000'", **columns("threshold", digits=12),
    "threshold_method": text_sql("3 * sum(abs(I_e)) / (4 * W * H)"), "original_width": "'8'", "original_height": "'8'", "edge_width": "'4'", "edge_height": "'4'", "edge_pixels": "edge_pixels::VARCHAR"}


@query(CROSSING_SQL + f"SELECT image_id, {document_sql(CROSSING_FIELDS)} AS json FROM z")
def zero_crossing_json(spark, d):
    images = to_images(embedding_tiles(spark, d))
    told = rounded(filters.zero_crossing_report(images, 5, 1.0), "threshold").withColumns({"kernel_size": F.lit(5), "sigma": F.lit(1.0)})
    sized = images.select("image_id", F.col("width").alias("original_width"), F.col("height").alias("original_height"))
    return written(sized.join(told, "image_id"), documents.zero_crossing_layout("e.png"), fixed(12))


OTSU_FIELDS = {"input": "'\"' || image_id || '\"'", "binary_output": text_sql("b.png"), "method": text_sql("Otsu thresholding"), **SIZE_TILES, "threshold": "(CASE WHEN n1 = 0 THEN 0 ELSE v END)::VARCHAR"}
OTSU_FIELDS |= {
    f"class_{k}": {"condition": text_sql(f"pixel {sign} threshold"), "output_value": f"'{value}'", "pixel_count": f"n{k}::BIGINT::VARCHAR", "probability": fixed_sql(f"round(p{k}, 6)", 12), "mean": fixed_sql(f"round(mean{k}, 6)", 12)}
    for k, sign, value in ((0, "<=", 0), (1, ">", 255))
}
OTSU_FIELDS |= {"within_class_variance": fixed_sql("round(CASE WHEN n1 = 0 THEN 0 ELSE p0 * (t0 / n0 - mean0 * mean0) + p1 * ((t - t0) / n1 - mean1 * mean1) END, 4)", 12), "between_class_variance": fixed_sql("round(b, 4)", 12)}


@query(OTSU_SQL.format(raster=TILES) + f"SELECT image_id, {document_sql(OTSU_FIELDS)} AS json FROM g WHERE k = 1")
def otsu_json(spark, d):
    images = to_images(embedding_tiles(spark, d))
    found = rounded(rounded(statistics.otsu(to_pixels(images)), "p0", "p1", "mean0", "mean1"), "within_var", "between_var", digits=4)
    return written(images.select("image_id", "width", "height").join(found, "image_id"), documents.otsu_layout("b.png"), fixed(12))


def _component_sql(number, *more: str) -> dict:
    out = {k: f"{k}::VARCHAR" for k in ("label", "area", "min_x", "min_y", "max_x", "max_y")} | {k: number(k) for k in more}
    out |= {"raw_moments": {k: number(k) for k in ("m00", "m10", "m01")}, "centroid": {k: number(f"centroid_{k}") for k in "xy"}}
    return out | {"central_moments": {k: number(f"round({k}, 6) + 0.0") for k in ("mu20", "mu02", "mu11")}}


def _short(expression: str) -> str:
    return f"printf('%g', ({expression})::DOUBLE)"


IMAGES_OF_TILES = f"(SELECT DISTINCT image_id FROM {TILES})"
COMPONENTS_FIELDS = {"input": "'\"' || i.image_id || '\"'", "labels_output": text_sql("l.png"), "method": text_sql("4-connected component labeling"), "foreground_condition": text_sql("pixel != 0"), **SIZE_TILES,
    "component_count": "count(label)::VARCHAR", "components": list_sql(object_sql(_component_sql(_short), 2), "label", where="label IS NOT NULL")}


@query(LABEL_SQL + f"SELECT i.image_id, {document_sql(COMPONENTS_FIELDS)} AS json FROM {IMAGES_OF_TILES} i LEFT JOIN c ON c.image_id = i.image_id GROUP BY i.image_id")
def components_json(spark, d):
    images = to_images(statistics.binarize(embedding_tiles(spark, d), 127))
    found = rounded(components.components(components.labels(images)), "centroid_x", "centroid_y", "mu20", "mu02", "mu11")
    return written(images.select("image_id", "width", "height").join(sinks.nested(found, "components"), "image_id", "left"), documents.components_layout("l.png"), significant)


KR2 = f"({2 * math.pi!r} * (mu20 + mu02) / (area * area))"
CIRCLES_FIELDS = {"input": "'\"' || i.image_id || '\"'", "highlighted_output": text_sql("h.png"), "method": text_sql("large circle-like component detection"), "foreground_condition": text_sql("pixel != 0"), **SIZE_TILES,
    "component_count": "count(label)::VARCHAR", "selected_count": "count(label) FILTER (area > 4 AND roundness_deviation <= 0.1)::VARCHAR", "criteria": {"min_area_exclusive": "'4'", "roundness_kr2_formula": text_sql("2 * pi * (mu20 + mu02) / S^2"), "target_roundness_kr2": "'1.000000000000'", "max_roundness_deviation": "'0.100000000000'"},
    "selected_components": list_sql(object_sql(_component_sql(lambda e: fixed_sql(e if e[0] == "m" else f"round({e}, 6)" if not e.startswith("round(") else e, 12), "roundness_kr2", "roundness_deviation"), 2), "label", where="area > 4 AND roundness_deviation <= 0.1")}


@query(LABEL_SQL + f", k AS (SELECT *, {KR2} AS roundness_kr2, abs({KR2} - 1) AS roundness_deviation FROM c) SELECT i.image_id, {document_sql(CIRCLES_FIELDS)} AS json FROM {IMAGES_OF_TILES} i LEFT JOIN k ON k.image_id = i.image_id GROUP BY i.image_id")
def circles_json(spark, d):
    images = to_images(statistics.binarize(embedding_tiles(spark, d), 127))
    every = components.components(components.labels(images))
    found = rounded(components.round_components(every, min_area=4, max_deviation=0.1), "centroid_x", "centroid_y", "mu20", "mu02", "mu11", "roundness_kr2", "roundness_deviation")
    counts = every.groupBy("image_id").agg(F.count("*").alias("component_count"))
    rows = images.select("image_id", "width", "height").join(counts, "image_id", "left").join(sinks.nested(found, "circles"), "image_id", "left")
    return written(rows, documents.circles_layout(4, 0.1, "h.png"), fixed(12))


def turned_sql(raster: str, degrees: float, method: str) -> str:
    """Turned there and back and cut to the original size: sizes between, and the error."""
    return f"""SELECT '{method}' AS method, rotated_width, rotated_height, round(m, 6) AS mse, round(CASE WHEN m = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(255 / sqrt(m)) END, 6) AS psnr_db, image_id FROM (
      WITH o AS (SELECT * FROM {raster}), there AS MATERIALIZED ({rotation_sql('o', degrees, method)}), back AS MATERIALIZED ({rotation_sql('there', -degrees, method)}),
      sized AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM o GROUP BY 1), big AS (SELECT image_id, max(x) + 1 AS bw, max(y) + 1 AS bh FROM back GROUP BY 1), mid AS (SELECT image_id, (max(x) + 1)::INT AS rotated_width, (max(y) + 1)::INT AS rotated_height FROM there GROUP BY 1)
      SELECT o.image_id, rotated_width, rotated_height, avg((o.v - coalesce(b.v, 0)) * (o.v - coalesce(b.v, 0))) AS m FROM o JOIN sized USING (image_id) JOIN big USING (image_id) JOIN mid USING (image_id)
      LEFT JOIN back b ON b.image_id = o.image_id AND b.y = o.y + trunc((bh - h) / 2) AND b.x = o.x + trunc((bw - w) / 2) GROUP BY 1, 2, 3)"""


METHODS = ("nearest", "bilinear", "bicubic")
#: An angle at which no source place falls on the edge between two pixels, where sine and cosine of two libraries may differ.
TURN = 29.3
TURNED = " UNION ALL ".join(f"(SELECT *, {TURN}::DOUBLE AS angle FROM ({turned_sql(TILES, TURN, m)}))" for m in METHODS)


@query(TURNED)
def rotation_report(spark, d):
    return rounded(experiments.rotation_report(to_images(embedding_tiles(spark, d)), TURN), "mse", "psnr_db")


TURN_FIELDS = {"method": "'\"' || method || '\"'", "rotated_width": "rotated_width::VARCHAR", "rotated_height": "rotated_height::VARCHAR", "rotation_ms": "'0.000000000000'", "inverse_rotation_ms": "'0.000000000000'", "roundtrip_mse": fixed_sql("mse", 12), "roundtrip_psnr_db": fixed_sql("psnr_db", 12)}
TURN_DOCUMENT = {"input": "'\"' || image_id || '\"'", "angle_degrees": f"'{TURN:.12f}'", "quality_method": text_sql("rotate by angle, rotate back by negative angle, center-crop to original size"), "original_width": "'8'", "original_height": "'8'",
    "methods": list_sql(object_sql(TURN_FIELDS, 2), "list_position(['nearest', 'bilinear', 'bicubic'], method)")}


@query(f"SELECT image_id, {document_sql(TURN_DOCUMENT)} AS json FROM ({TURNED}) GROUP BY image_id")
def rotation_json(spark, d):
    rows = experiments.rotation_rows(to_images(embedding_tiles(spark, d)), TURN)
    names = ("method", "rotated_width", "rotated_height", "rotation_ms", "inverse_rotation_ms")
    six = F.transform("methods", lambda m: F.struct(*[m[n].alias(n) for n in names], *[F.round(m[n], 6).alias(n) for n in ("mse", "psnr_db")]))
    return written(rows.withColumn("methods", six), documents.rotation_layout(TURN), fixed(12))


REGION_FIELDS = {k: f"{k}::BIGINT::VARCHAR" for k in documents.REGION}
REGIONS_SQL = "(SELECT " + list_sql(object_sql(REGION_FIELDS, 2), "id") + " AS image_regions, count(*) AS n_regions FROM (SELECT image_region_id AS id, count(*) AS block_count, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM m WHERE image_region_id >= 0 GROUP BY 1))"
PAGE_SIZE = f"(SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {SCAN})"
BLOCK_FIELDS = {k: f"{k}::BIGINT::VARCHAR" for k in ("x", "y", "width", "height")} | {"class": "'\"' || class || '\"'"} | {k: f"{k}::VARCHAR" for k in ("image_region_id", "image_neighbor_count")}
BLOCK_FIELDS |= {k: fixed_sql(f"round({k}, 6) + 0.0", 10) for k in blocks.FEATURES}
BLOCKS_DOCUMENT = {"input": text_sql("scan"), "overlay_output": text_sql("o.png"), "width": "w::VARCHAR", "height": "h::VARCHAR", "block_size": "'10'", "grid_width": "ceil(w / 10)::INT::VARCHAR", "grid_height": "ceil(h / 10)::INT::VARCHAR", "method": text_sql("block histogram heuristic"),
    "postprocessing": {"connectivity": "'4'", "min_image_region_blocks": "'3'", "min_image_neighbors": "'1'"}, "legend": {"text": text_sql("unchanged"), "image": text_sql("red overlay"), "background": text_sql("unchanged")},
    "counts": {c: f"n_{c}::VARCHAR" for c in ("background", "text", "image")}, "image_regions": "image_regions", "blocks": "blocks"}


@query(
    MERGE_SQL + f"""SELECT 'scan' AS image_id, {document_sql(BLOCKS_DOCUMENT)} AS json FROM {PAGE_SIZE}, {REGIONS_SQL}, (SELECT {", ".join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in ("background", "text", "image"))}, {list_sql(object_sql(BLOCK_FIELDS, 2), '"row", col')} AS blocks FROM m)"""
)
def blocks_json(spark, d):
    images = to_images(document_scan(spark, d))
    found = experiments.page(images, PAGE)
    found["blocks"] = rounded(found["blocks"], *blocks.FEATURES)
    return written(experiments.page_rows(images, found), documents.blocks_layout(PAGE.block_size, PAGE.min_region_blocks, PAGE.min_neighbors, "o.png"), fixed(10))


OPTIONS = {"block_size": "'10'", "min_region_blocks": "'3'", "min_neighbors": "'1'", "rectangle_padding_fraction": f"'{PAGE.padding:.10f}'", "gaussian_kernel_size": f"'{PAGE.blur_size}'", "gaussian_sigma": f"'{PAGE.blur_sigma:.10f}'", "sharpen_amount": f"'{PAGE.sharpen_amount:.10f}'"}
RESTORED_DOCUMENT = {"input": text_sql("scan"), "restored_output": text_sql("r.png"), "blurred_output": text_sql("b.png"), "width": "w::VARCHAR", "height": "h::VARCHAR", "options": OPTIONS, "processing_mask": text_sql("image rectangles built without text-like boundary blocks"),
    "processed_region_count": "n_regions::VARCHAR", "image_region_count": "n_regions::VARCHAR", "image_regions": "image_regions"}


@query(MERGE_SQL + f"SELECT 'scan' AS image_id, {document_sql(RESTORED_DOCUMENT)} AS json FROM {PAGE_SIZE}, {REGIONS_SQL}")
def restoration_json(spark, d):
    images = to_images(document_scan(spark, d))
    rows = images.select("image_id", "width", "height").join(sinks.nested(experiments.page(images, PAGE)["regions"], "regions"), "image_id", "left")
    return written(rows, documents.restoration_layout(PAGE, "r.png", "b.png"), fixed(10))


# restoration

BLUR = kernels.gaussian(PAGE.blur_size, PAGE.blur_sigma)
_R = PAGE.blur_size // 2
BLUR_TAPS = ", ".join(f"({dy - _R}, {dx - _R}, {w!r}::DOUBLE)" for dy, dx, w in kernel_cells(BLUR))
NEAR_HALF = "round({e}, 7)"  # products of doubles are added in different orders: ties are settled at 7 decimals


@query(
    REGION_SQL + f""", held AS MATERIALIZED (SELECT p.y, p.x, p.v, (SELECT count(*) > 0 FROM z WHERE n > 0 AND p.x >= z.l AND p.x < z.r AND p.y >= z.t AND p.y < z.b) AS inside FROM p),
    spread AS (SELECT a.y + k.dy AS y, a.x + k.dx AS x, sum(a.v * k.w) AS s, sum(k.w) AS w FROM held a, (VALUES {BLUR_TAPS}) k(dy, dx, w) WHERE a.inside GROUP BY 1, 2),
    blurred AS MATERIALIZED (SELECT h.y, h.x, h.inside, (CASE WHEN h.inside THEN {pixel(NEAR_HALF.format(e='s / w'))} ELSE h.v END)::INT AS v FROM held h LEFT JOIN spread USING (y, x)),
    around AS (SELECT c.y, c.x, sum(coalesce(n.v, c.v)) AS s FROM blurred c, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx) LEFT JOIN blurred n ON n.y = c.y + k.dy AND n.x = c.x + k.dx AND n.inside WHERE c.inside GROUP BY 1, 2)
    SELECT 'scan' AS image_id, b.y, b.x, (CASE WHEN b.inside THEN {pixel(NEAR_HALF.format(e=f'b.v + {PAGE.sharpen_amount!r}::DOUBLE * (4 * b.v - a.s)'))} ELSE b.v END)::SMALLINT AS v FROM blurred b LEFT JOIN around a USING (y, x)"""
)
def restored_page(spark, d):
    """Masked blur, then masked sharpening, within the boxes of the page's image regions."""
    return to_pixels(experiments.page(to_images(document_scan(spark, d)), PAGE)["restored"])


# pictures of signals

SPECTRUM_SQL = f"""WITH f AS (SELECT signal_id, k.k, sum(value * cos(2 * pi() * ((k.k * idx) % 64) / 64)) AS re, -sum(value * sin(2 * pi() * ((k.k * idx) % 64) / 64)) AS im FROM {SIGNALS}, range(64) k(k) GROUP BY 1, 2),
a AS (SELECT signal_id, (k + 32) % 64 AS k, ln(1 + sqrt(re * re + im * im)) AS amplitude FROM f), t AS (SELECT *, max(amplitude) OVER (PARTITION BY signal_id) AS top FROM a),
s AS (SELECT signal_id, k, round(least(255, greatest(0, round(amplitude / top * 255, 7)))) AS v FROM t)
"""


def _lit(images, value: str, schema: str):
    """Rows of what a function of each plane gives."""

    def told(plane: np.ndarray) -> dict:
        if value == "bars":
            lit = plane == 255
            return {"x": np.arange(plane.shape[1], dtype=np.int32), "bar": lit.sum(axis=0).astype(np.int32), "low": np.where(lit.any(axis=0), plane.shape[0] - 1 - lit[::-1].argmax(axis=0), -1).astype(np.int32)}
        y, x = np.nonzero(plane)
        return {"y": y.astype(np.int32), "x": x.astype(np.int32), "v": plane[y, x].astype(np.int16)}

    return map_rows(images, told, schema)


@query(SPECTRUM_SQL + "SELECT signal_id AS image_id, x::INT AS x, round(v / 255 * 256)::INT AS bar, (CASE WHEN round(v / 255 * 256) > 0 THEN 255 ELSE -1 END)::INT AS low FROM s, range(512) c(x) WHERE s.k = x // 8")
def signal_spectra(spark, d):
    """The pictures' bars: how many pixels of each column are white, and the lowest of them."""
    return _lit(fourier.signal_spectrum_images(embedding_signals(spark, d)), "bars", "x int, bar int, low int")


PLOT_SQL = f"""WITH RECURSIVE g AS (SELECT signal_id, least(min(value), 0) AS l, greatest(max(value), 0) AS h FROM {SIGNALS} GROUP BY 1), r AS (SELECT signal_id, CASE WHEN l = h THEN l - 1 ELSE l END AS low, CASE WHEN l = h THEN h + 1 ELSE h END AS high FROM g),
p AS (SELECT signal_id, idx, least(255, greatest(0, round((high - value) / (high - low) * 255)))::INT AS y, round(idx * 511 / 63)::INT AS x FROM {SIGNALS} JOIN r USING (signal_id)),
e AS (SELECT a.signal_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, abs(b.x - a.x) AS dx, -abs(b.y - a.y) AS dy, CASE WHEN a.x < b.x THEN 1 ELSE -1 END AS sx, CASE WHEN a.y < b.y THEN 1 ELSE -1 END AS sy FROM p a JOIN p b ON a.signal_id = b.signal_id AND b.idx = a.idx + 1),
w AS (SELECT signal_id, x0 AS x, y0 AS y, x1, y1, dx, dy, sx, sy, dx + dy AS error FROM e
  UNION ALL SELECT signal_id, x + CASE WHEN 2 * error >= dy THEN sx ELSE 0 END, y + CASE WHEN 2 * error <= dx THEN sy ELSE 0 END, x1, y1, dx, dy, sx, sy, error + CASE WHEN 2 * error >= dy THEN dy ELSE 0 END + CASE WHEN 2 * error <= dx THEN dx ELSE 0 END FROM w WHERE x <> x1 OR y <> y1),
lit AS (SELECT DISTINCT signal_id, y, x FROM w), axis AS (SELECT signal_id, least(255, greatest(0, round(high / (high - low) * 255)))::INT AS y, c.x::INT AS x FROM r, range(512) c(x)),
shown AS (SELECT signal_id, y, x, 255 AS v FROM lit UNION ALL SELECT a.signal_id, a.y, a.x, 64 FROM axis a LEFT JOIN lit l ON l.signal_id = a.signal_id AND l.y = a.y AND l.x = a.x WHERE l.y IS NULL)
SELECT signal_id AS image_id, x, count(*) FILTER (v = 255) AS white, sum(y) FILTER (v = 255)::BIGINT AS sum_y, sum(y * y) FILTER (v = 255)::BIGINT AS sum_yy, coalesce(max(y) FILTER (v = 64), -1)::INT AS axis_y FROM shown GROUP BY 1, 2"""


@query(PLOT_SQL)
def signal_plots(spark, d):
    """For each column of the pictures: how many pixels the polyline lights, where, and where the line at zero shows beneath it."""
    lit = _lit(fourier.signal_plots(embedding_signals(spark, d)), "pixels", "y int, x int, v smallint")
    white, y = F.col("v") == 255, F.col("y").cast("long")
    return lit.groupBy("image_id", "x").agg(F.count_if(white).alias("white"), F.sum(F.when(white, y)).alias("sum_y"), F.sum(F.when(white, y * y)).alias("sum_yy"), F.coalesce(F.max(F.when(F.col("v") == 64, F.col("y"))), F.lit(-1)).alias("axis_y"))


# noise

GRADIENT = 512


@query(f"SELECT 'gradient' AS image_id, {GRADIENT} AS width, {GRADIENT} AS height, 365.298858643::DOUBLE AS mse, 22.504320456::DOUBLE AS psnr_db")
def noise_figure(spark, d):
    """Gaussian noise of variance 400 and seed 1 on the gradient v = x div 2: the published error of these very draws."""
    pixels = spark.range(GRADIENT * GRADIENT).select(F.lit("gradient").alias("image_id"), F.expr(f"cast(id div {GRADIENT} as int)").alias("y"), F.expr(f"cast(id % {GRADIENT} as int)").alias("x"), F.expr(f"cast((id % {GRADIENT}) div 2 as smallint)").alias("v"))
    images = to_images(pixels)
    return rounded(quality.quality_of_images(images, filters.gaussian_noise(images, 400.0, 1)), "mse", "psnr_db", digits=9)


# files


def _decoded(files, column: str):
    """image_id, y, x, r, g, b of files held as bytes."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("image_id").to_pylist(), batch.column(column).to_pylist(), strict=True):
                rgb = formats.decode_rgb(data)
                y, x = np.divmod(np.arange(rgb.shape[0] * rgb.shape[1], dtype=np.int32), rgb.shape[1])
                flat = rgb.reshape(-1, 3).astype(np.int16)
                yield pa.record_batch({"image_id": pa.array([name] * len(x)), "y": y, "x": x, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.mapInArrow(run, PIXELS_RGB)


def _coloured(spark, d):
    return embedding_tiles(spark, d).selectExpr("image_id", "y", "x", "v AS r", "cast(255 - v AS smallint) AS g", "cast((v * 7) % 256 AS smallint) AS b")


COLOURED = f"SELECT image_id, y, x, v::SMALLINT AS r, (255 - v)::SMALLINT AS g, ((v * 7) % 256)::SMALLINT AS b FROM {TILES}"
GREYED = f"SELECT image_id, y, x, v::SMALLINT AS v FROM {TILES}"


@query(COLOURED)
def png_rgb_round_trip(spark, d):
    return _decoded(sinks.image_files_rgb(_coloured(spark, d), "png"), "file")


@query(COLOURED)
def tiff_rgb_round_trip(spark, d):
    return _decoded(sinks.image_files_rgb(_coloured(spark, d), "tiff"), "file")


@query(COLOURED)
def bmp_rgb_round_trip(spark, d):
    return _decoded(sinks.image_files_rgb(_coloured(spark, d), "bmp"), "file")


@query(COLOURED)
def ppm_round_trip(spark, d):
    return _decoded(sinks.image_files_rgb(_coloured(spark, d), "ppm"), "file")


@query(GREYED)
def pgm_round_trip(spark, d):
    return _decoded(sinks.image_files(to_images(embedding_tiles(spark, d)), "pgm"), "file").select("image_id", "y", "x", F.col("r").alias("v"))


@query(GREYED)
def tiff_round_trip(spark, d):
    """Gray TIFF files of every kind that is read: either byte order, one to many strips, white or black as 0."""

    def write(batches):
        for batch in batches:
            for k, (name, w, h, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "height", "pixels")), strict=True)):
                kind = k % 12
                plane = np.frombuffer(data, np.uint8).reshape(h, w)
                yield pa.record_batch({"image_id": [name], "file": pa.array([formats.encode_tiff(plane, order="<>"[kind % 2], strip_rows=(1, 3, h)[kind % 3], white_is_zero=kind // 6 == 1)], pa.binary())})

    files = to_images(embedding_tiles(spark, d)).mapInArrow(write, "image_id string, file binary")
    return _decoded(files, "file").select("image_id", "y", "x", F.col("r").alias("v"))


@query(f"SELECT signal_id, idx, value FROM {SIGNALS}")
def signal_text(spark, d):
    """Signals written as text and read again by the reader's rules: numbers apart by commas, semicolons, blanks and line ends."""
    apart = F.array(F.lit(", "), F.lit(";"), F.lit("\n"), F.lit("  \t"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda v: F.concat(v["value"].cast("string"), F.get(apart, v["idx"] % 4)))
    texts = embedding_signals(spark, d).groupBy("signal_id").agg(F.array_join(words, "").alias("value"))
    return readers.signals_of(texts)


BOX_TEXT = "0.25 0 -1\n0;2,0.5\n\n-1 0 0.25\n"


@query("SELECT dy::INT AS dy, dx::INT AS dx, w FROM (VALUES (0, 0, 0.25::DOUBLE), (0, 1, 0::DOUBLE), (0, 2, -1::DOUBLE), (1, 0, 0::DOUBLE), (1, 1, 2::DOUBLE), (1, 2, 0.5::DOUBLE), (2, 0, -1::DOUBLE), (2, 1, 0::DOUBLE), (2, 2, 0.25::DOUBLE)) k(dy, dx, w)")
def kernel_text(spark, d):
    return spark.createDataFrame([(dy, dx, w) for dy, dx, w in kernel_cells(readers.parse_kernel(BOX_TEXT))], "dy int, dx int, w double")


@query("SELECT dy::INT AS dy, dx::INT AS dx FROM (VALUES (0, 1), (1, 0), (1, 1), (1, 2), (2, 1)) k(dy, dx)")
def aperture_text(spark, d):
    return spark.createDataFrame([(dy, dx) for dy, dx, _ in aperture_cells(readers.parse_aperture("0 1 0\n1,1;1\n0 1 0").astype(int).tolist())], "dy int, dx int")


# stencils beyond size 3

LAPLACIAN_5, SHARPEN_5 = kernels.laplacian(5), kernels.sharpening(5, 1.0)


@query(f"SELECT image_id, y, x, round(r, 6) + 0.0 AS r FROM ({windows_sql(ORDERS, kernel_cells(LAPLACIAN_5), 5, 5, 'sum(p.v * k.w) AS r')})")
def laplacian_response_5(spark, d):
    return rounded(filters.response(to_images(orders_raster(spark, d)), LAPLACIAN_5), "r")


@query(f"SELECT image_id, y, x, round(r, 6) + 0.0 AS r FROM ({windows_sql(ORDERS, kernel_cells(SHARPEN_5), 5, 5, 'sum(p.v * k.w) AS r')})")
def sharpen_response_5(spark, d):
    """The response before it is rounded to pixels: sums of fifths lie on ties, which each order of adding breaks its own way."""
    return rounded(filters.response(to_images(orders_raster(spark, d)), SHARPEN_5), "r")


LAPLACIAN_7 = kernels.laplacian(7)


@query(f"SELECT image_id, y, x, round(r, 6) + 0.0 AS r FROM ({windows_sql(ORDERS, kernel_cells(LAPLACIAN_7), 7, 7, 'sum(p.v * k.w) AS r')})")
def laplacian_response_7(spark, d):
    return rounded(filters.response(to_images(orders_raster(spark, d)), LAPLACIAN_7), "r")


#: The first 128 uniform numbers of the generator at seed 1, two words each: a tile's 64 pixels need no more.
UNIFORM_SQL = """WITH RECURSIVE seeded(i, s) AS (SELECT 0, 1::BIGINT UNION ALL SELECT i + 1, (1812433253::BIGINT * xor(s, s >> 30) + i + 1) & 4294967295 FROM seeded WHERE i < 623),
halves AS (SELECT a.i AS k, xor(((a.s & 2147483648) | (b.s & 2147483647)) >> 1, CASE WHEN b.s & 1 = 1 THEN 2567483615 ELSE 0 END) AS t FROM seeded a JOIN seeded b ON b.i = a.i + 1),
early AS (SELECT k, xor(c.s, t) AS w FROM halves JOIN seeded c ON c.i = k + 397 WHERE k < 227),
words AS (SELECT * FROM early UNION ALL SELECT h.k, xor(e.w, h.t) FROM halves h JOIN early e ON e.k = h.k - 227 WHERE h.k BETWEEN 227 AND 255),
t1 AS (SELECT k, xor(w, w >> 11) AS w FROM words), t2 AS (SELECT k, xor(w, (w << 7) & 2636928640) AS w FROM t1), t3 AS (SELECT k, xor(w, (w << 15) & 4022730752) AS w FROM t2), t4 AS (SELECT k, xor(w, w >> 18) AS w FROM t3),
u AS (SELECT a.k // 2 AS n, least(1 - 1 / 9007199254740992.0::DOUBLE, (a.w::DOUBLE + b.w::DOUBLE * 4294967296::DOUBLE) / 18446744073709551616::DOUBLE) AS u FROM t4 a JOIN t4 b ON b.k = a.k + 1 WHERE a.k % 2 = 0)"""


@query(
    UNIFORM_SQL + f""", tries AS (SELECT a.n // 2 AS t, -1 + 2 * a.u AS x, -1 + 2 * b.u AS y FROM u a JOIN u b ON b.n = a.n + 1 WHERE a.n % 2 = 0),
    good AS (SELECT row_number() OVER (ORDER BY t) - 1 AS pair, x, y, x * x + y * y AS s FROM tries WHERE x * x + y * y <= 1 AND x * x + y * y > 0),
    normal AS (SELECT 2 * pair AS i, x * sqrt(-2 * ln(s) / s) AS z FROM good UNION ALL SELECT 2 * pair + 1, y * sqrt(-2 * ln(s) / s) FROM good)
    SELECT p.image_id, p.y, p.x, {pixel('p.v + 20 * z')} AS v FROM {TILES} p JOIN normal ON normal.i = p.y * 8 + p.x"""
)
def gaussian_noise_tiles(spark, d):
    return to_pixels(filters.gaussian_noise(to_images(embedding_tiles(spark, d)), 400.0, 1))


@query(
    UNIFORM_SQL.replace("u AS (", "u AS MATERIALIZED (", 1) + f""", walk(i, n, hit) AS (SELECT 0, 0, (SELECT u < 0.3::DOUBLE FROM u WHERE n = 0) UNION ALL
      SELECT w.i + 1, w.n + CASE WHEN w.hit THEN 2 ELSE 1 END, u.u < 0.3::DOUBLE FROM walk w JOIN u ON u.n = w.n + CASE WHEN w.hit THEN 2 ELSE 1 END WHERE w.i < 63)
    SELECT p.image_id, p.y, p.x, (CASE WHEN NOT w.hit THEN p.v WHEN u.u < 0.5::DOUBLE THEN 0 ELSE 255 END)::SMALLINT AS v FROM {TILES} p JOIN walk w ON w.i = p.y * 8 + p.x LEFT JOIN u ON u.n = w.n + 1"""
)
def impulse_noise_tiles(spark, d):
    return to_pixels(filters.impulse_noise(to_images(embedding_tiles(spark, d)), 0.3, 1))


# what readers and builders accept

_PLANE = np.arange(12, dtype=np.uint8).reshape(3, 4)
_GOOD, _RGB = formats.encode_tiff(_PLANE), formats.encode_tiff(np.stack([_PLANE] * 3, axis=-1))


def _field(data: bytes, tag: int, *, kind: int | None = None, value: int | None = None, drop: bool = False) -> bytes:
    """A little-endian TIFF with one field of its directory changed, or its tag made one that isn't read."""
    out = bytearray(data)
    for at in range(10, 10 + 12 * out[8], 12):
        if int.from_bytes(out[at : at + 2], "little") == tag:
            if kind is not None:
                out[at + 2 : at + 4] = kind.to_bytes(2, "little")
            if value is not None:
                out[at + 8 : at + 12] = value.to_bytes(4, "little")
            if drop:
                out[at : at + 2] = (65_000).to_bytes(2, "little")
    return bytes(out)


#: Files, and what reading them says.
TIFF_CASES = {
    "gray": (_GOOD, "ok"),
    "gray, big end first": (formats.encode_tiff(_PLANE, order=">"), "ok"),
    "gray, strips of a line": (formats.encode_tiff(_PLANE, strip_rows=1), "ok"),
    "colour": (_RGB, "ok"),
    "byte order": (b"IM" + _GOOD[2:], "unknown image format"),
    "magic number": (_GOOD[:2] + b"\x2b" + _GOOD[3:], "TIFF: bad magic number"),
    "no directory": (_GOOD[:8], "TIFF: truncated"),
    "half a directory": (_GOOD[:40], "TIFF: truncated"),
    "half a strip": (_GOOD[:-3], "TIFF: truncated"),
    "type of a field": (_field(_GOOD, 256, kind=2), "TIFF: field type 2 of tag 256"),
    "no strips": (_field(_GOOD, 273, drop=True), "TIFF: no offsets"),
    "no size": (_field(_field(_GOOD, 256, drop=True), 257, drop=True), "TIFF: no height, width"),
    "no width": (_field(_GOOD, 256, value=0), "TIFF: empty image"),
    "16 bits": (_field(_GOOD, 258, value=16), "TIFF: bits must be 8"),
    "packed": (_field(_GOOD, 259, value=5), "TIFF: only uncompressed, chunky images"),
    "planes apart": (_field(_GOOD, 284, value=2), "TIFF: only uncompressed, chunky images"),
    "palette": (_field(_GOOD, 262, value=3), "TIFF: only 8-bit gray and RGB"),
    "too few pixels": (_field(_GOOD, 279, value=7), "TIFF: too few pixels"),
    "empty": (b"", "unknown image format"),
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


@query(f"SELECT * FROM (VALUES {_values((n, m) for n, (_, m) in TIFF_CASES.items())}) t(name, said)")
def tiff_checks(spark, d):
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    said = "ok" if formats.decode_rgb(data).shape == (3, 4, 3) else "another size"
                except formats.FormatError as e:
                    said = str(e)
                yield pa.record_batch({"name": [name], "said": [said]})

    return spark.createDataFrame([(n, bytearray(data)) for n, (data, _) in TIFF_CASES.items()], "name string, data binary").mapInArrow(run, "name string, said string")


#: Texts of kernels and apertures, and whether they are accepted.
MATRIX_CASES = [("1", True, True), ("0 1 0,1 1 1;0 1 0".replace(";", "\n").replace(",", "\n"), True, True), ("1 2\n3 4", False, False), ("1 2 3", True, False), ("1\n2\n3", True, False), ("1 0 1", True, True), ("0 0 0", True, False), ("", False, False), ("1 x 1", False, False), ("1 nan 1", False, False), ("1 2 3\n4 5", False, False), ("-1 2.5 1e3", True, False)]


def _accepts(parse, text: str) -> bool:
    try:
        return parse(text) is not None
    except ValueError:
        return False


@query("SELECT text, kernel = 'True' AS kernel, aperture = 'True' AS aperture FROM (VALUES " + _values((t.replace("\n", "/"), k, a) for t, k, a in MATRIX_CASES) + ") t(text, kernel, aperture)")
def matrix_checks(spark, d):
    """Odd sizes, rows of one length, finite numbers; apertures of 0 and 1 with an active cell."""
    return spark.createDataFrame([(t.replace("\n", "/"), _accepts(readers.parse_kernel, t), _accepts(readers.parse_aperture, t)) for t, _, _ in MATRIX_CASES], "text string, kernel boolean, aperture boolean")


@query("SELECT name, operation FROM (VALUES ('erosion', 'erosion'), ('erode', 'erosion'), ('dilation', 'dilation'), ('dilate', 'dilation'), ('opening', 'opening'), ('open', 'opening'), ('closing', 'closing'), ('close', 'closing'), ('four', '4'), ('eight', '3'), ('min', '0'), ('median', '4'), ('max', '8')) t(name, operation)")
def named_choices(spark, d):
    """Names of morphological operations, of Laplacians (the centre of the 3 x 3 kernel) and of ranks among nine cells."""
    centres = [(n, str(int(abs(kernels.laplacian(3, n)[1, 1])))) for n in ("four", "eight")]
    ranks = [(n, str(kernels.rank_number(n, 9))) for n in ("min", "median", "max")]
    return spark.createDataFrame([*kernels.MORPHOLOGY.items(), *centres, *ranks], "name string, operation string")


@query("SELECT n::INT AS n, (1::BIGINT << ceil(log2(n))::INT)::BIGINT AS size FROM range(1, 5000) t(n)")
def transform_sizes(spark, d):
    return spark.createDataFrame([(n, kernels.next_power_of_two(n)) for n in range(1, 5000)], "n int, size long")

"""Named queries over the supplied tables, with the SQL that states the same result."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.operators import blocks, components, cooccurrence, filters, fourier, quality, statistics
from rasterloom.operators.frames import info, to_images, to_pixels
from rasterloom.plans import experiments
from rasterloom.plans.rasters import EVENTS, ORDERS, SCAN, SIGNALS, TILES, document_scan, embedding_signals, embedding_tiles, events_raster, orders_raster
from rasterloom.sources import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FULL_3 = [[1] * 3] * 3
DIAMOND_5 = [[0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0]]
PAGE = blocks.PageOptions(block_size=10, min_region_blocks=3, min_neighbors=1)


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the same result in SQL if that can be stated."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def rounded(df, *columns: str, digits: int = 6):
    """Doubles to so many decimals; adding 0.0 makes negative zero zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def windows_sql(raster: str, cells: list[tuple[int, int, float]], height: int, width: int, value: str) -> str:
    """image_id, y, x and a value for each valid window of (v, w) pairs."""
    taps = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in cells)
    return f"""SELECT p.image_id, p.y - k.dy AS y, p.x - k.dx AS x, {value}
      FROM {raster} p JOIN (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM {raster} GROUP BY image_id) s USING (image_id), (VALUES {taps}) k(dy, dx, w)
      WHERE p.y - k.dy BETWEEN 0 AND s.h - {height} AND p.x - k.dx BETWEEN 0 AND s.w - {width} GROUP BY 1, 2, 3"""


def kernel_cells(kernel) -> list[tuple[int, int, float]]:
    return [(dy, dx, float(kernel[dy][dx])) for dy in range(len(kernel)) for dx in range(len(kernel[0]))]


def aperture_cells(mask) -> list[tuple[int, int, float]]:
    return [(dy, dx, 1.0) for dy, dx, on in kernel_cells(mask) if on]


def pixel(expression: str) -> str:
    return f"least(255, greatest(0, round({expression})))::SMALLINT"


# sources and sinks


@query(f"SELECT image_id, y, x, v::SMALLINT AS v FROM {ORDERS}")
def raster_round_trip(spark, d):
    """Pixels put together to planes and taken apart again."""
    return to_pixels(to_images(orders_raster(spark, d)))


@query(f"SELECT image_id AS path, max(x) + 1 AS width, max(y) + 1 AS height, 1 AS channels, 'uint8' AS type FROM {TILES} GROUP BY 1")
def info_tiles(spark, d):
    return info(to_images(embedding_tiles(spark, d)))


@query(f"SELECT image_id, y, x, v::SMALLINT AS v FROM {TILES}")
def png_round_trip(spark, d):
    """Planes written as PNG and decoded again."""
    import numpy as np
    import pyarrow as pa

    from rasterloom.operators.frames import PIXELS
    from rasterloom.sources.formats import decode_gray

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plane = decode_gray(data)
                y, x = np.divmod(np.arange(plane.size, dtype=np.int32), plane.shape[1])
                yield pa.record_batch({"image_id": pa.array([name] * plane.size), "y": y, "x": x, "v": plane.ravel().astype(np.int16)})

    return sinks.image_files(to_images(embedding_tiles(spark, d))).mapInArrow(read, PIXELS)


@query(f"SELECT image_id, y, x, ((299 * v + 587 * (255 - v) + 114 * 100 + 500) // 1000)::SMALLINT AS v FROM {ORDERS}")
def rgb_to_gray(spark, d):
    from rasterloom.sources.readers import gray_of

    return gray_of(orders_raster(spark, d).selectExpr("image_id", "y", "x", "v AS r", "cast(255 - v AS smallint) AS g", "cast(100 AS smallint) AS b"))


# histograms, statistics, co-occurrence, quality


@query(f"SELECT 'orders' AS image_id, b.bin::SMALLINT AS bin, count(p.v) AS cnt FROM range(256) b(bin) LEFT JOIN {ORDERS} p ON p.v = b.bin GROUP BY b.bin")
def histogram_orders(spark, d):
    return statistics.histogram(orders_raster(spark, d))


STATS_SQL = """
WITH p AS (SELECT * FROM {raster}), m AS (SELECT image_id, avg(v) AS mean, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT image_id, v, count(*) AS cnt FROM p GROUP BY 1, 2),
r AS (SELECT c.*, m.mean, m.n, c.v - m.mean AS off, c.cnt / m.n AS p, sum(c.cnt) OVER (PARTITION BY c.image_id ORDER BY c.v) AS upto FROM c JOIN m USING (image_id)),
a AS (SELECT image_id, max(n) AS pixels, max(mean) AS mean, sum(off * off * p) AS variance, sum(off ** 3 * p) AS m3, sum(off ** 4 * p) AS m4, -sum(p * log2(p)) AS entropy, sum(p * p) AS energy,
  min(CASE WHEN upto >= greatest(1, ceil(0.25 * n)) THEN v END)::DOUBLE AS q1, min(CASE WHEN upto >= greatest(1, ceil(0.5 * n)) THEN v END)::DOUBLE AS q2, min(CASE WHEN upto >= greatest(1, ceil(0.75 * n)) THEN v END)::DOUBLE AS q3
  FROM r GROUP BY 1)
SELECT image_id, pixels, round(mean, 6) AS mean, round(variance, 6) AS variance, q1, q2, q3, round(entropy, 6) AS entropy, round(energy, 6) AS energy,
  round(CASE WHEN variance = 0 THEN 0 ELSE m3 / variance ** 1.5 END, 6) + 0.0 AS skewness, round(CASE WHEN variance = 0 THEN 0 ELSE m4 / variance ** 2 - 3 END, 6) + 0.0 AS kurtosis FROM a"""
STATS = ("mean", "variance", "entropy", "energy", "skewness", "kurtosis")


@query(STATS_SQL.format(raster=TILES))
def stats_tiles(spark, d):
    return rounded(statistics.statistics(embedding_tiles(spark, d)), *STATS)


@query(STATS_SQL.format(raster=ORDERS))
def stats_orders(spark, d):
    return rounded(statistics.statistics(orders_raster(spark, d)), *STATS)



@query(
    f"""WITH h AS (SELECT b.bin, count(p.v) AS cnt FROM range(256) b(bin) LEFT JOIN {ORDERS} p ON p.v = b.bin GROUP BY b.bin),
    t AS (SELECT bin, CASE WHEN cnt > 0 THEN least(256, greatest(1, round(cnt / max(cnt) OVER () * 256))) ELSE 0 END AS bar FROM h)
    SELECT 'orders' AS image_id, y::INT AS y, (2 * bin + k)::INT AS x, (CASE WHEN 255 - y < bar THEN 0 ELSE 255 END)::SMALLINT AS v FROM t, range(256) r(y), range(2) z(k)"""
)
def histogram_picture(spark, d):
    return to_pixels(statistics.histogram_images(statistics.sparse_histogram(orders_raster(spark, d))))


def glcm_sql(raster: str, dr: int, dc: int) -> str:
    return f"SELECT a.image_id, {dr} AS dr, {dc} AS dc, a.v::SMALLINT AS first, b.v::SMALLINT AS second, count(*) AS cnt FROM {raster} a JOIN {raster} b ON a.image_id = b.image_id AND b.y = a.y + {dr} AND b.x = a.x + {dc} GROUP BY 1, 4, 5"


@query(glcm_sql(ORDERS, 0, 1))
def glcm_row_pixels(spark, d):
    return cooccurrence.cooccurrence(orders_raster(spark, d), 0, 1)


@query(glcm_sql(ORDERS, 1, -2))
def glcm_diagonal_pixels(spark, d):
    return cooccurrence.cooccurrence(orders_raster(spark, d), 1, -2)


@query(glcm_sql(ORDERS, 1, -2))
def glcm_planes(spark, d):
    return cooccurrence.cooccurrence_of_images(to_images(orders_raster(spark, d)), 1, -2)


@query(f"SELECT image_id, dr, dc, sum(cnt)::BIGINT AS total_pairs, round(sum(cnt::DOUBLE * cnt) / sum(cnt) / sum(cnt), 9) AS energy FROM ({glcm_sql(TILES, 1, 1)}) GROUP BY 1, 2, 3")
def glcm_energy(spark, d):
    return rounded(cooccurrence.energy(cooccurrence.cooccurrence_of_images(to_images(embedding_tiles(spark, d)), 1, 1)), "energy", digits=9)


@query(f"SELECT *, sum(cnt) OVER (PARTITION BY image_id)::BIGINT AS total_pairs, round(cnt / sum(cnt) OVER (PARTITION BY image_id), 9) AS p FROM ({glcm_sql(TILES, 0, 1)})")
def glcm_probabilities(spark, d):
    return rounded(cooccurrence.probabilities(cooccurrence.cooccurrence(embedding_tiles(spark, d), 0, 1)), "p", digits=9)


@query(
    f"""WITH g AS ({glcm_sql(ORDERS, 0, 1)}) SELECT 'orders' AS image_id, y::INT AS y, x::INT AS x, (255 - round(coalesce(cnt, 0) / (SELECT max(cnt) FROM g) * 255))::SMALLINT AS v
    FROM range(256) a(y), range(256) b(x) LEFT JOIN g ON g.first = y AND g.second = x"""
)
def glcm_picture(spark, d):
    return cooccurrence.rendered(cooccurrence.cooccurrence(orders_raster(spark, d), 0, 1))


QUALITY_SQL = f"""WITH t AS (SELECT image_id, y, x, v, CASE WHEN v > 127 THEN 255 ELSE 0 END AS w FROM {TILES}), q AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, avg((v - w) * (v - w)) AS mse FROM t GROUP BY 1)
SELECT image_id, width, height, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(255 / sqrt(mse)) END, 6) AS psnr_db FROM q"""


@query(QUALITY_SQL)
def quality_pixels(spark, d):
    tiles = embedding_tiles(spark, d)
    return rounded(quality.quality(tiles, statistics.binarize(tiles, 127)), "mse", "psnr_db")


@query(QUALITY_SQL)
def quality_planes(spark, d):
    tiles = embedding_tiles(spark, d)
    return rounded(quality.quality_of_images(to_images(tiles), to_images(statistics.binarize(tiles, 127))), "mse", "psnr_db")


@query(
    f"""WITH a AS (SELECT * FROM {ORDERS}), b AS (SELECT * FROM {EVENTS}), j AS (SELECT a.v - b.v AS d, a.x, a.y FROM a JOIN b USING (y, x)), q AS (SELECT max(x) + 1 AS width, max(y) + 1 AS height, avg(d * d) AS mse FROM j)
    SELECT 'overlap' AS image_id, width, height, round(mse, 6) AS mse, round(20 * log10(255 / sqrt(mse)), 6) AS psnr_db FROM q"""
)
def quality_overlap(spark, d):
    """Two rasters over the places that both have."""
    a, b = (r.withColumn("image_id", F.lit("overlap")) for r in (orders_raster(spark, d), events_raster(spark, d)))
    place = ["y", "x"]
    return rounded(quality.quality(a.join(b.select(*place), place, "left_semi"), b.join(a.select(*place), place, "left_semi")), "mse", "psnr_db")


OTSU_SQL = """
WITH h AS (SELECT image_id, v, count(*) AS cnt FROM {raster} GROUP BY 1, 2),
c AS (SELECT image_id, v, sum(cnt) OVER u AS n0, sum(cnt * v) OVER u AS s0, sum(cnt * v * v) OVER u AS t0, sum(cnt) OVER i AS n, sum(cnt * v) OVER i AS s, sum(cnt * v * v) OVER i AS t
  FROM h WINDOW u AS (PARTITION BY image_id ORDER BY v), i AS (PARTITION BY image_id)),
e AS (SELECT *, n - n0 AS n1, n0 / n AS p0, (n - n0) / n AS p1, s0 / n0 AS mean0, CASE WHEN n > n0 THEN (s - s0) / (n - n0) ELSE 0 END AS mean1 FROM c),
f AS (SELECT *, CASE WHEN n1 > 0 THEN p0 * p1 * (mean0 - mean1) * (mean0 - mean1) ELSE 0 END AS b FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n1 > 0 DESC, b DESC, v) AS k FROM f)
"""
OTSU_ROWS = """SELECT image_id, (CASE WHEN n1 = 0 THEN 0 ELSE v END)::SMALLINT AS threshold, n0::BIGINT AS n0, n1::BIGINT AS n1, round(p0, 6) AS p0, round(p1, 6) AS p1, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1,
  round(CASE WHEN n1 = 0 THEN 0 ELSE p0 * (t0 / n0 - mean0 * mean0) + p1 * ((t - t0) / n1 - mean1 * mean1) END, 4) AS within_var, round(b, 4) AS between_var FROM g WHERE k = 1"""


def _otsu(raster):
    found = rounded(statistics.otsu(raster), "p0", "p1", "mean0", "mean1")
    return rounded(found, "within_var", "between_var", digits=4)


@query(OTSU_SQL.format(raster=TILES) + OTSU_ROWS)
def otsu_tiles(spark, d):
    return _otsu(embedding_tiles(spark, d))


@query(OTSU_SQL.format(raster=ORDERS) + OTSU_ROWS)
def otsu_orders(spark, d):
    return _otsu(orders_raster(spark, d))


@query(OTSU_SQL.format(raster=TILES) + f"SELECT p.image_id, p.y, p.x, (CASE WHEN p.v <= g.v THEN 0 ELSE 255 END)::SMALLINT AS v FROM {TILES} p JOIN g USING (image_id) WHERE g.k = 1")
def otsu_binarize(spark, d):
    return statistics.otsu_binarize(embedding_tiles(spark, d))


# linear filters

BOX = kernels.average(3)
LAPLACIAN = kernels.laplacian(3)
LOG = kernels.laplacian_of_gaussian(5, 1.0)
BOX_SUM = [(dy, dx, 1.0) for dy, dx, _ in kernel_cells(BOX)]  # whole sums, divided once: no rounding depends on the order
LOW_PASS_SQL = windows_sql(ORDERS, BOX_SUM, 3, 3, pixel("sum(p.v * k.w) / 9") + " AS v")


@query(LOW_PASS_SQL)
def low_pass(spark, d):
    return to_pixels(filters.low_pass(to_images(orders_raster(spark, d)), 3))


@query(LOW_PASS_SQL)
def low_pass_pixels(spark, d):
    """The same as a shuffle of partial sums."""
    return filters.convolve_pixels(orders_raster(spark, d), BOX)


@query(f"SELECT s.image_id, s.y, s.x, (CASE WHEN abs(s.v - p.v) >= 20 THEN s.v ELSE p.v END)::SMALLINT AS v FROM ({LOW_PASS_SQL}) s JOIN {ORDERS} p ON p.y = s.y + 1 AND p.x = s.x + 1")
def threshold_low_pass(spark, d):
    return to_pixels(filters.threshold_low_pass(to_images(orders_raster(spark, d)), 3, 20))


@query(windows_sql(ORDERS, kernel_cells(LAPLACIAN), 3, 3, "sum(p.v * k.w) AS r"))
def laplacian_response(spark, d):
    return filters.response(to_images(orders_raster(spark, d)), LAPLACIAN).withColumn("r", F.col("r") + 0.0)


@query(f"WITH r AS ({windows_sql(ORDERS, kernel_cells(LAPLACIAN), 3, 3, 'sum(p.v * k.w) AS r')}) SELECT image_id, y, x, {pixel('abs(r) * (255.0 / (SELECT max(abs(r)) FROM r))')} AS v FROM r")
def laplacian_magnitude(spark, d):
    return to_pixels(filters.laplacian(to_images(orders_raster(spark, d))))


@query(windows_sql(ORDERS, kernel_cells(kernels.sharpening(3, 1.0)), 3, 3, pixel("sum(p.v * k.w)") + " AS v"))
def sharpen(spark, d):
    return to_pixels(filters.sharpen(to_images(orders_raster(spark, d)), 3, 1.0))


@query(windows_sql(TILES, kernel_cells(LOG), 5, 5, "round(sum(p.v * k.w), 6) + 0.0 AS r"))
def log_response_pixels(spark, d):
    return rounded(filters.response_pixels(embedding_tiles(spark, d), LOG), "r")


@query(windows_sql(TILES, kernel_cells(kernels.laplacian(3, "eight")), 3, 3, "round(sum(p.v * k.w), 6) + 0.0 AS r"))
def laplacian_eight_response(spark, d):
    return rounded(filters.response(to_images(embedding_tiles(spark, d)), kernels.laplacian(3, "eight")), "r")


@query(f"WITH r AS ({windows_sql(ORDERS, kernel_cells(kernels.laplacian_of_gaussian(7, 1.4)), 7, 7, 'sum(p.v * k.w) AS r')}) SELECT image_id, y, x, {pixel('abs(r) * (255.0 / (SELECT max(abs(r)) FROM r))')} AS v FROM r")
def log_filter(spark, d):
    return to_pixels(filters.laplacian_of_gaussian(to_images(orders_raster(spark, d)), 7, 1.4))


ZERO_SQL = f"""
WITH r AS ({windows_sql(ORDERS, kernel_cells(LAPLACIAN), 3, 3, 'sum(p.v * k.w) AS r')}), t AS (SELECT 3 * sum(abs(r)) / (4 * count(*)) AS t FROM r),
n AS (SELECT *, lag(r) OVER a AS w, lead(r) OVER a AS e, lag(r) OVER b AS n, lead(r) OVER b AS s FROM r WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)),
z AS (SELECT image_id, y, x, CASE WHEN {' OR '.join(f'(sign(r) * sign({k}) < 0 AND abs(r - {k}) >= (SELECT t FROM t))' for k in 'wens')} THEN 255 ELSE 0 END::SMALLINT AS v FROM n)
"""


@query(ZERO_SQL + "SELECT * FROM z")
def zero_crossing_pixels(spark, d):
    found = filters.response_pixels(orders_raster(spark, d), LAPLACIAN)
    return filters.zero_crossings_pixels(found, filters.zero_crossing_threshold(found))


@query(ZERO_SQL + "SELECT image_id, count(*) FILTER (v <> 0) AS edge_pixels FROM z GROUP BY 1")
def zero_crossing_count(spark, d):
    found = filters.response_pixels(orders_raster(spark, d), LAPLACIAN)
    return filters.count_edges(filters.zero_crossings_pixels(found, filters.zero_crossing_threshold(found)))


@query(
    f"""WITH r AS ({windows_sql(TILES, kernel_cells(LOG), 5, 5, 'sum(p.v * k.w) AS r')}), t AS (SELECT image_id, 3 * sum(abs(r)) / (4 * count(*)) AS t FROM r GROUP BY 1),
    n AS (SELECT r.*, t.t, lag(r) OVER a AS w, lead(r) OVER a AS e, lag(r) OVER b AS n, lead(r) OVER b AS s FROM r JOIN t USING (image_id) WINDOW a AS (PARTITION BY r.image_id, y ORDER BY x), b AS (PARTITION BY r.image_id, x ORDER BY y))
    SELECT image_id, round(max(t), 6) AS threshold, 4 AS edge_width, 4 AS edge_height, count(*) FILTER ({' OR '.join(f'(sign(r) * sign({k}) < 0 AND abs(r - {k}) >= t)' for k in 'wens')}) AS edge_pixels FROM n GROUP BY 1"""
)
def zero_crossing_report(spark, d):
    return rounded(filters.zero_crossing_report(to_images(embedding_tiles(spark, d)), 5, 1.0), "threshold")


# rank filters and morphology

SORTED = "list_sort(list(p.v))"


@query(windows_sql(ORDERS, aperture_cells(FULL_3), 3, 3, f"{SORTED}[5]::SMALLINT AS v"))
def median(spark, d):
    return to_pixels(filters.rank_filter(to_images(orders_raster(spark, d)), FULL_3, "median"))


@query(windows_sql(ORDERS, aperture_cells(DIAMOND_5), 5, 5, f"{SORTED}[4]::SMALLINT AS v"))
def rank_diamond(spark, d):
    return to_pixels(filters.rank_filter(to_images(orders_raster(spark, d)), DIAMOND_5, 3))


@query(windows_sql(ORDERS, aperture_cells(FULL_3), 3, 3, pixel(f"list_sum({SORTED}[3:7]) / 5") + " AS v"))
def trimmed_mean(spark, d):
    return to_pixels(filters.trimmed_mean(to_images(orders_raster(spark, d)), FULL_3, 4))


def extreme_sql(raster: str, pick: str) -> str:
    return windows_sql(raster, aperture_cells(FULL_3), 3, 3, f"{pick}(p.v)::SMALLINT AS v")


ERODED, DILATED = extreme_sql(ORDERS, "min"), extreme_sql(ORDERS, "max")


@query(ERODED)
def erosion(spark, d):
    return to_pixels(filters.morphology(to_images(orders_raster(spark, d)), FULL_3, "erosion"))


@query(DILATED)
def dilation_pixels(spark, d):
    return filters.extreme_pixels(orders_raster(spark, d), FULL_3, "dilation")


@query(extreme_sql(f"({ERODED})", "max"))
def opening(spark, d):
    return to_pixels(filters.morphology(to_images(orders_raster(spark, d)), FULL_3, "opening"))


@query(extreme_sql(f"({DILATED})", "min"))
def closing(spark, d):
    return to_pixels(filters.morphology(to_images(orders_raster(spark, d)), FULL_3, "closing"))


# geometry


def rotation_sql(raster: str, degrees: float, method: str) -> str:
    """For each image size: the output grid, each place's source, and the taps around it."""
    turn = math.radians(degrees)
    c, s = repr(math.cos(turn)), repr(math.sin(turn))
    at = f"SELECT image_id, h, w, r, q, (least_x + q + 0.5) * {c} - (least_y + r + 0.5) * {s} + w / 2 - 0.5 AS sx, (least_x + q + 0.5) * {s} + (least_y + r + 0.5) * {c} + h / 2 - 0.5 AS sy FROM grid"
    corners = ", ".join(f"({a} * w / 2 * {c} + {b} * h / 2 * {s}, -({a} * w / 2) * {s} + {b} * h / 2 * {c})" for a in (-1, 1) for b in (-1, 1))
    head = f"""WITH p AS (SELECT * FROM {raster}), size AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY 1),
    corner AS (SELECT image_id, h, w, k.cx, k.cy FROM size, LATERAL (VALUES {corners}) k(cx, cy)),
    box AS (SELECT image_id, h, w, min(cx) AS least_x, min(cy) AS least_y, greatest(1, ceil(max(cx) - min(cx) - 1e-9))::INT AS ow, greatest(1, ceil(max(cy) - min(cy) - 1e-9))::INT AS oh FROM corner GROUP BY 1, 2, 3),
    grid AS (SELECT b.*, r.r, q.q FROM box b, LATERAL (SELECT unnest(range(b.oh)) AS r) r, LATERAL (SELECT unnest(range(b.ow)) AS q) q), src AS ({at})"""
    if method == "nearest":
        return head + " SELECT g.image_id, g.r::INT AS y, g.q::INT AS x, coalesce(p.v, 0)::SMALLINT AS v FROM src g LEFT JOIN p ON p.image_id = g.image_id AND p.x = floor(g.sx + 0.5)::INT AND p.y = floor(g.sy + 0.5)::INT"
    inside = "g.sx >= 0 AND g.sy >= 0 AND g.sx <= g.w - 1 AND g.sy <= g.h - 1"
    dx, dy = "(g.sx - floor(g.sx))", "(g.sy - floor(g.sy))"
    if method == "bilinear":
        taps = " ".join(f"LEFT JOIN p p{j}{i} ON p{j}{i}.image_id = g.image_id AND p{j}{i}.x = floor(g.sx)::INT + {i} AND p{j}{i}.y = floor(g.sy)::INT + {j}" for j in (0, 1) for i in (0, 1))
        across = [f"(coalesce(p{j}0.v, 0) * (1.0::DOUBLE - {dx}) + coalesce(p{j}1.v, 0) * {dx})" for j in (0, 1)]
        value = pixel(f"{across[0]} * (1.0::DOUBLE - {dy}) + {across[1]} * {dy}")
        return head + f" SELECT g.image_id, g.r::INT AS y, g.q::INT AS x, (CASE WHEN {inside} THEN {value} ELSE 0 END)::SMALLINT AS v FROM src g {taps}"
    basis = "CASE k.{b} WHEN -1 THEN -{t} * ({t} - 1) * ({t} - 2) / 6 WHEN 0 THEN ({t} + 1) * ({t} - 1) * ({t} - 2) / 2 WHEN 1 THEN -({t} + 1) * {t} * ({t} - 2) / 2 ELSE ({t} + 1) * {t} * ({t} - 1) / 6 END"
    weight = {"sx": basis.format(b="i", t=dx), "sy": basis.format(b="j", t=dy)}
    taps = "(-1), (0), (1), (2)"
    total = f"sum(({weight['sx']}) * ({weight['sy']}) * coalesce(p.v, 0))"
    return head + f""", k AS (SELECT i, j FROM (VALUES {taps}) a(i), (VALUES {taps}) b(j)),
    m AS (SELECT g.image_id, g.r, g.q, {total} AS v FROM src g CROSS JOIN k LEFT JOIN p ON p.image_id = g.image_id AND p.x = floor(g.sx)::INT + k.i AND p.y = floor(g.sy)::INT + k.j WHERE {inside} GROUP BY 1, 2, 3)
    SELECT g.image_id, g.r::INT AS y, g.q::INT AS x, {pixel('round(coalesce(m.v, 0), 9)')} AS v FROM src g LEFT JOIN m ON m.image_id = g.image_id AND m.r = g.r AND m.q = g.q"""


@query(rotation_sql(ORDERS, 30, "nearest"))
def rotate_nearest(spark, d):
    return filters.rotate_to_pixels(to_images(orders_raster(spark, d)), 30, "nearest")


@query(rotation_sql(TILES, 30, "bilinear"))
def rotate_bilinear(spark, d):
    return to_pixels(filters.rotate(to_images(embedding_tiles(spark, d)), 30, "bilinear"))


@query(rotation_sql(TILES, -45, "bicubic"))
def rotate_bicubic(spark, d):
    return to_pixels(filters.rotate(to_images(embedding_tiles(spark, d)), -45, "bicubic"))


@query(rotation_sql(ORDERS, 30, "nearest"))
def rotate_nearest_pixels(spark, d):
    """The same as a join of places and pixels."""
    return filters.rotate_pixels(orders_raster(spark, d), 30, "nearest")


@query(rotation_sql(TILES, -45, "bicubic"))
def rotate_bicubic_pixels(spark, d):
    return filters.rotate_pixels(embedding_tiles(spark, d), -45, "bicubic")


@query(f"SELECT t.image_id, y.y::INT AS y, x.x::INT AS x, coalesce(p.v, 0)::SMALLINT AS v FROM (SELECT DISTINCT image_id FROM {TILES}) t, range(5) y(y), range(11) x(x) LEFT JOIN {TILES} p ON p.image_id = t.image_id AND p.y = y.y + 1 AND p.x = x.x - 1")
def crop_or_pad(spark, d):
    return to_pixels(filters.crop_or_pad(to_images(embedding_tiles(spark, d)), 5, 11))


# components

LABEL_SQL = f"""
WITH RECURSIVE f AS (SELECT image_id, y, x, y * 8 + x AS i FROM {TILES} WHERE v > 127),
reach AS (SELECT image_id, i, i AS j FROM f UNION SELECT r.image_id, r.i, n.i FROM reach r JOIN f a ON a.image_id = r.image_id AND a.i = r.j JOIN f n ON n.image_id = a.image_id AND abs(n.y - a.y) + abs(n.x - a.x) = 1),
least AS (SELECT image_id, i, min(j) AS root FROM reach GROUP BY 1, 2),
l AS (SELECT f.image_id, f.y, f.x, (dense_rank() OVER (PARTITION BY f.image_id ORDER BY least.root))::INT AS label FROM f JOIN least USING (image_id, i)),
s AS (SELECT image_id, label, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy FROM l GROUP BY 1, 2),
c AS (SELECT image_id, label, area, min_x, min_y, max_x, max_y, area::DOUBLE AS m00, sx AS m10, sy AS m01, round(sx / area, 6) AS centroid_x, round(sy / area, 6) AS centroid_y,
  sxx - sx * sx / area AS mu20, syy - sy * sy / area AS mu02, sxy - sx * sy / area AS mu11 FROM s)
"""
MOMENTS = "image_id, label, area, min_x, min_y, max_x, max_y, m00, m10, m01, centroid_x, centroid_y, round(mu20, 6) + 0.0 AS mu20, round(mu02, 6) + 0.0 AS mu02, round(mu11, 6) + 0.0 AS mu11"
ROUNDED_MOMENTS = ("centroid_x", "centroid_y", "mu20", "mu02", "mu11")


def _labels(spark, d):
    return components.labels(to_images(statistics.binarize(embedding_tiles(spark, d), 127)))


@query(LABEL_SQL + "SELECT * FROM l")
def labels_tiles(spark, d):
    return _labels(spark, d)


@query(LABEL_SQL + f"SELECT {MOMENTS} FROM c")
def components_tiles(spark, d):
    return rounded(components.components(_labels(spark, d)), *ROUNDED_MOMENTS)


@query(
    LABEL_SQL + f"""SELECT {MOMENTS}, round({2 * math.pi!r} * (mu20 + mu02) / (area * area), 6) AS roundness_kr2, round(abs({2 * math.pi!r} * (mu20 + mu02) / (area * area) - 1), 6) AS roundness_deviation
    FROM c WHERE area > 4 AND abs({2 * math.pi!r} * (mu20 + mu02) / (area * area) - 1) <= 0.1"""
)
def circles_tiles(spark, d):
    found = components.round_components(components.components(_labels(spark, d)), min_area=4, max_deviation=0.1)
    return rounded(found, *ROUNDED_MOMENTS, "roundness_kr2", "roundness_deviation")


@query(LABEL_SQL + "SELECT image_id, y, x, (label * 37 % 255 + 1)::SMALLINT AS v FROM l")
def label_greys(spark, d):
    return components.label_greys(_labels(spark, d))


def _colour_sql(selected: str | None) -> str:
    from rasterloom.functions.planes import OTHER_LABEL, PALETTE

    return ", ".join(
        (f"(CASE WHEN {selected} THEN " if selected else "(") + "CASE (label - 1) % 12 " + " ".join(f"WHEN {k} THEN {int(p[c])}" for k, p in enumerate(PALETTE)) + " END" + (f" ELSE {OTHER_LABEL[c]} END" if selected else "") + f")::SMALLINT AS {n}"
        for c, n in enumerate("rgb")
    )


@query(LABEL_SQL + f"SELECT image_id, y, x, {_colour_sql(None)} FROM l")
def label_colours(spark, d):
    return components.label_colours(_labels(spark, d))


@query(LABEL_SQL + f"SELECT image_id, y, x, {_colour_sql('area > 4')} FROM l JOIN (SELECT image_id, label, area FROM s) a USING (image_id, label)")
def selected_colours(spark, d):
    labelled = _labels(spark, d)
    return components.label_colours(labelled, components.components(labelled).where("area > 4"))


# scanned pages

BLOCK_SQL = f"""
WITH p AS (SELECT *, y // 10 AS br, x // 10 AS bc FROM {SCAN}), e AS (SELECT br, bc, min(v) AS low, max(v) AS high FROM p GROUP BY 1, 2),
n AS (SELECT p.*, CASE WHEN high > low THEN ((v - low) * 255 + (high - low) // 2) // (high - low) ELSE v END AS w FROM p JOIN e USING (br, bc)),
line AS (SELECT br, bc, y, count(*) FILTER (w <= 85) AS dark, count(*) AS width FROM n GROUP BY 1, 2, 3),
proj AS (SELECT br, bc, avg(dark / width) AS a1, avg((dark / width) * (dark / width)) AS a2, avg(CASE WHEN dark >= greatest(1.0, width * 0.08::DOUBLE) THEN 1 ELSE 0 END) AS active FROM line GROUP BY 1, 2),
f AS (SELECT 'scan' AS image_id, br::INT AS row, bc::INT AS col, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) FILTER (v >= 245) / count(*) AS white_ratio, count(*) FILTER (v <= 128) / count(*) AS dark_ratio,
  count(*) FILTER (v < 245) / count(*) AS nonwhite_ratio, count(*) FILTER (v >= 64 AND v < 245) / count(*) AS midtone_ratio, count(*) FILTER (w >= 205) / count(*) AS normalized_white_ratio, count(*) FILTER (w <= 85) / count(*) AS normalized_dark_ratio,
  count(*) FILTER (w >= 80 AND w < 205) / count(*) AS normalized_midtone_ratio, avg(v) AS mean, avg(v * v) - avg(v) * avg(v) AS variance FROM n GROUP BY br, bc),
g AS (SELECT f.*, CASE WHEN active < 0.08 OR active > 0.90 THEN 0 ELSE sqrt(greatest(0, a2 - a1 * a1)) * (1 - abs(active - 0.45)) END AS text_projection_score FROM f JOIN proj ON proj.br = f.row AND proj.bc = f.col),
c AS (SELECT *, CASE WHEN nonwhite_ratio < 0.015 THEN 'background'
  WHEN (white_ratio >= 0.70 AND nonwhite_ratio >= 0.015 AND midtone_ratio < 0.20 AND dark_ratio < 0.30)
    OR (normalized_white_ratio >= 0.45 AND normalized_dark_ratio BETWEEN 0.02 AND 0.45 AND normalized_midtone_ratio <= 0.45 AND text_projection_score >= 0.22)
    OR (white_ratio BETWEEN 0.50 AND 0.72 AND nonwhite_ratio <= 0.55 AND dark_ratio <= 0.35 AND midtone_ratio <= 0.30 AND normalized_white_ratio >= 0.60 AND normalized_dark_ratio <= 0.34 AND normalized_midtone_ratio <= 0.18 AND text_projection_score >= 0.06) THEN 'text'
  WHEN white_ratio < 0.70 OR nonwhite_ratio >= 0.45 OR midtone_ratio >= 0.20 OR dark_ratio >= 0.14 THEN 'image' ELSE 'background' END AS class FROM g)
"""
MERGE_SQL = BLOCK_SQL.replace("WITH p", "WITH RECURSIVE p", 1).rstrip() + """,
i AS (SELECT row, col, row * 100000 + col AS k FROM c WHERE class = 'image'),
near AS (SELECT a.k, count(b.k) AS around FROM i a LEFT JOIN i b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1),
hop(k, root) AS (SELECT k, k FROM i UNION SELECT a.k, h.root FROM hop h JOIN i b ON b.k = h.k JOIN i a ON abs(a.row - b.row) + abs(a.col - b.col) = 1 WHERE a.k > h.root),
roots AS (SELECT k, min(root) AS root FROM hop GROUP BY 1),
kept AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS id FROM roots JOIN near USING (k) GROUP BY root HAVING count(*) >= 3 AND max(around) >= 1),
m AS (SELECT c.* EXCLUDE (class), CASE WHEN c.class = 'image' AND kept.id IS NULL THEN CASE WHEN nonwhite_ratio < 0.015 THEN 'background' ELSE 'text' END ELSE c.class END AS class, coalesce(kept.id, -1)::INT AS image_region_id,
  (CASE WHEN kept.id IS NULL THEN 0 ELSE near.around END)::INT AS image_neighbor_count FROM c LEFT JOIN roots ON roots.k = c.row * 100000 + c.col LEFT JOIN kept USING (root) LEFT JOIN near ON near.k = c.row * 100000 + c.col)
"""
FEATURE_SQL = ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in blocks.FEATURES)


@query(BLOCK_SQL + f'SELECT image_id, row, col, x, y, width, height, class, {FEATURE_SQL} FROM c')
def block_classes(spark, d):
    return rounded(blocks.classify(document_scan(spark, d), 10), *blocks.FEATURES)


def _page(spark, d):
    return blocks.merge(blocks.classify(document_scan(spark, d), PAGE.block_size), PAGE.min_region_blocks, PAGE.min_neighbors)


@query(MERGE_SQL + f"SELECT image_id, row, col, x, y, width, height, class, image_region_id, image_neighbor_count, {FEATURE_SQL} FROM m")
def merged_blocks(spark, d):
    return rounded(_page(spark, d), *blocks.FEATURES)


@query(MERGE_SQL + "SELECT image_id, image_region_id AS id, count(*)::INT AS block_count, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM m WHERE image_region_id >= 0 GROUP BY 1, 2")
def image_regions(spark, d):
    return blocks.regions(_page(spark, d))


@query(MERGE_SQL + "SELECT image_id, class, count(*) AS blocks FROM m GROUP BY 1, 2")
def class_counts(spark, d):
    return blocks.class_counts(_page(spark, d))


REGION_SQL = MERGE_SQL.rstrip() + """,
b AS (SELECT *, class = 'text' OR (white_ratio >= 0.65 AND nonwhite_ratio BETWEEN 0.015 AND 0.35 AND midtone_ratio <= 0.25 AND dark_ratio <= 0.35)
  OR (normalized_white_ratio >= 0.45 AND normalized_dark_ratio BETWEEN 0.02 AND 0.45 AND normalized_midtone_ratio <= 0.45 AND text_projection_score >= 0.22) AS held FROM m),
own AS (SELECT image_region_id AS id, count(*) FILTER (class = 'image' AND NOT held) AS n, min(x) FILTER (class = 'image' AND NOT held) AS x0, min(y) FILTER (class = 'image' AND NOT held) AS y0,
  max(x + width) FILTER (class = 'image' AND NOT held) AS x1, max(y + height) FILTER (class = 'image' AND NOT held) AS y1 FROM b WHERE image_region_id >= 0 GROUP BY 1),
padded AS (SELECT *, greatest(0, x0 - 2) AS l0, greatest(0, y0 - 2) AS t0, least((SELECT max(x + width) FROM b), x1 + 2) AS r0, least((SELECT max(y + height) FROM b), y1 + 2) AS b0 FROM own),
cut AS (SELECT o.id, max(w.y + w.height) FILTER (ox AND w.y + w.height <= y0) AS t, max(w.x + w.width) FILTER (oy AND w.x + w.width <= x0) AS l, min(w.x) FILTER (oy AND w.x >= x1) AS r,
  min(w.y) FILTER (ox AND w.y >= y1 AND w.y < b0 AND w.height = 10) AS whole, min(CASE WHEN w.y > 2 THEN w.y - 2 ELSE w.y END) FILTER (ox AND w.y >= y1 AND w.y < b0 AND w.height < 10) AS part
  FROM padded o, LATERAL (SELECT b.*, o.x0 < b.x + b.width AND b.x < o.x1 AS ox, o.y0 < b.y + b.height AND b.y < o.y1 AS oy FROM b WHERE held) w GROUP BY 1),
z AS (SELECT p.id, n, greatest(l0, coalesce(c.l, l0)) AS l, greatest(t0, coalesce(c.t, t0)) AS t, least(r0, coalesce(c.r, r0)) AS r, coalesce(c.whole, c.part, b0) AS b FROM padded p LEFT JOIN cut c USING (id))
"""


@query(REGION_SQL + "SELECT 'scan' AS image_id, id, n::INT AS block_count, (CASE WHEN n > 0 THEN l ELSE 0 END)::INT AS x, (CASE WHEN n > 0 THEN t ELSE 0 END)::INT AS y, (CASE WHEN n > 0 THEN r - l ELSE 0 END)::INT AS width, (CASE WHEN n > 0 THEN b - t ELSE 0 END)::INT AS height FROM z")
def processing_regions(spark, d):
    return blocks.processing_regions(_page(spark, d), PAGE)



@query(MERGE_SQL + "SELECT p.image_id, p.y, p.x, " + ", ".join(f"(CASE WHEN m.class = 'image' THEN {pixel(e)} ELSE p.v END)::SMALLINT AS {n}" for n, e in (("r", "p.v * (1 - 0.35::DOUBLE) + 255 * 0.35::DOUBLE"), ("g", "p.v * (1 - 0.35::DOUBLE)"), ("b", "p.v * (1 - 0.35::DOUBLE)"))) + " FROM p JOIN m ON m.row = p.br AND m.col = p.bc")
def block_overlay(spark, d):
    return blocks.overlays(to_images(document_scan(spark, d)), blocks.image_blocks(_page(spark, d)))


@query(
    REGION_SQL + "SELECT p.image_id, p.y, p.x, " + ", ".join(f"(CASE WHEN q.inside THEN {pixel(e)} ELSE p.v END)::SMALLINT AS {n}" for n, e in (("r", "p.v * (1 - 0.35::DOUBLE) + 255 * 0.35::DOUBLE"), ("g", "p.v * (1 - 0.35::DOUBLE)"), ("b", "p.v * (1 - 0.35::DOUBLE)")))
    + " FROM p, LATERAL (SELECT count(*) > 0 AS inside FROM z WHERE n > 0 AND p.x >= z.l AND p.x < z.r AND p.y >= z.t AND p.y < z.b) q"
)
def processing_overlay(spark, d):
    return blocks.overlays(to_images(document_scan(spark, d)), blocks.processing_regions(_page(spark, d), PAGE))


# Fourier transforms

DFT_SQL = f"SELECT signal_id, k.k::INT AS k, round(sum(value * cos(2 * pi() * ((k.k * idx) % 64) / 64)), 6) + 0.0 AS re, round(-sum(value * sin(2 * pi() * ((k.k * idx) % 64) / 64)), 6) + 0.0 AS im FROM {SIGNALS}, range(64) k(k) GROUP BY 1, 2"


@query(DFT_SQL)
def signal_fft(spark, d):
    return rounded(fourier.signal_spectrum(embedding_signals(spark, d)), "re", "im")


@query(DFT_SQL)
def signal_dft(spark, d):
    return rounded(fourier.signal_dft(embedding_signals(spark, d), 64), "re", "im")


@query(
    f"""WITH f AS (SELECT signal_id, k.k, sum(value * cos(2 * pi() * ((k.k * idx) % 64) / 64)) AS re, -sum(value * sin(2 * pi() * ((k.k * idx) % 64) / 64)) AS im FROM {SIGNALS}, range(64) k(k) GROUP BY 1, 2)
    SELECT signal_id, ((k + 32) % 64)::INT AS k, round(ln(1 + sqrt(re * re + im * im)), 6) + 0.0 AS amplitude FROM f"""
)
def signal_amplitudes(spark, d):
    return rounded(fourier.log_amplitudes(fourier.signal_dft(embedding_signals(spark, d), 64), 64), "amplitude")


@query(
    f"""SELECT p.image_id, a.v::INT AS v, b.u::INT AS u, round(sum(p.v * cos(2 * pi() * ((a.v * p.y + b.u * p.x) % 8) / 8)), 6) + 0.0 AS re, round(-sum(p.v * sin(2 * pi() * ((a.v * p.y + b.u * p.x) % 8) / 8)), 6) + 0.0 AS im
    FROM {TILES} p, range(8) a(v), range(8) b(u) GROUP BY 1, 2, 3"""
)
def image_fft(spark, d):
    return rounded(fourier.image_spectrum(to_images(embedding_tiles(spark, d))), "re", "im")



@query(ORACLE_SQL["image_fft"])
def image_fft_pixels(spark, d):
    """Rows, then columns, of every tile."""
    return rounded(fourier.image_spectrum_pixels(embedding_tiles(spark, d), 8), "re", "im")


@query(
    f"""WITH f AS (SELECT p.image_id, a.v, b.u, sum(p.v * cos(2 * pi() * ((a.v * p.y + b.u * p.x) % 8) / 8)) AS re, sum(p.v * sin(2 * pi() * ((a.v * p.y + b.u * p.x) % 8) / 8)) AS im FROM {TILES} p, range(8) a(v), range(8) b(u) GROUP BY 1, 2, 3),
    a AS (SELECT *, ln(1 + sqrt(re * re + im * im)) AS amplitude FROM f)
    SELECT image_id, ((v + 4) % 8)::INT AS y, ((u + 4) % 8)::INT AS x, {pixel('round(amplitude / max(amplitude) OVER (PARTITION BY image_id) * 255, 9)')} AS v FROM a"""
)
def image_spectrum(spark, d):
    return to_pixels(fourier.image_spectrum_images(to_images(embedding_tiles(spark, d))))



# noise and reports


@query()
def gaussian_noise(spark, d):
    return to_pixels(filters.gaussian_noise(to_images(orders_raster(spark, d)), 400.0, 1))


@query()
def impulse_noise(spark, d):
    return to_pixels(filters.impulse_noise(to_images(orders_raster(spark, d)), 0.05, 1))


from rasterloom.plans import reports  # noqa: E402, F401  (adds the queries of documents, reports and files)

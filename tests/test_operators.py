"""Operators over DataFrames: closed forms, edge cases, equal results of both forms, and errors."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import kernels, planes
from rasterloom.operators import blocks, components, cooccurrence, filters, fourier, quality, statistics
from rasterloom.operators.frames import IMAGES, PIXELS, to_images, to_pixels
from rasterloom.plans import catalog, experiments
from rasterloom.sources import documents

RNG = np.random.default_rng(11)


def images_of(spark, **named):
    return spark.createDataFrame([(n, p.shape[1], p.shape[0], bytes(np.ascontiguousarray(p, np.uint8).tobytes())) for n, p in named.items()], IMAGES)


def planes_back(images):
    return {r.image_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in images.collect()}


def test_statistics_of_few_values(spark):
    images = images_of(spark, four=np.array([[10, 20], [30, 40]]), flat=np.full((3, 3), 7), one=np.array([[200]]))
    got = {r.image_id: r for r in statistics.statistics(to_pixels(images)).collect()}
    four = got["four"]
    assert (four.mean, four.variance, four.q1, four.q2, four.q3, four.entropy, four.energy) == (25.0, 125.0, 10.0, 20.0, 30.0, 2.0, 0.25)
    assert four.skewness == pytest.approx(0) and four.kurtosis == pytest.approx(-1.36)
    assert (got["flat"].variance, got["flat"].skewness, got["flat"].kurtosis, got["flat"].entropy) == (0.0, 0.0, 0.0, 0.0)
    otsu = {r.image_id: r for r in statistics.otsu(to_pixels(images)).collect()}
    assert (otsu["flat"].threshold, otsu["flat"].n0, otsu["flat"].n1, otsu["flat"].mean0, otsu["flat"].between_var) == (0, 9, 0, 7.0, 0.0)
    assert otsu["four"].threshold == 20 and otsu["four"].between_var == pytest.approx(100.0)


def test_histogram_is_dense(spark):
    rows = statistics.histogram(to_pixels(images_of(spark, a=np.array([[3, 3, 9]])))).collect()
    assert len(rows) == 256 and {(r.bin, r.cnt) for r in rows if r.cnt} == {(3, 2), (9, 1)}


def test_gradient_statistics(spark):
    plane = np.repeat((np.arange(512) // 2)[None, :], 512, axis=0)
    r = statistics.statistics(to_pixels(images_of(spark, g=plane))).first()
    assert (r.mean, r.variance, r.q1, r.q2, r.q3) == (127.5, 5461.25, 63.0, 127.0, 191.0)
    assert r.entropy == pytest.approx(8) and r.energy == pytest.approx(1 / 256) and r.kurtosis == pytest.approx(-1.2000366217, abs=1e-9)


@pytest.mark.parametrize(("dr", "dc"), [(0, 1), (0, -2), (1, 0), (2, -1), (9, 9)])
def test_cooccurrence_forms_agree(spark, dr, dc):
    images = images_of(spark, a=RNG.integers(0, 4, (5, 6)), b=RNG.integers(0, 3, (4, 4)))
    pixel = cooccurrence.cooccurrence(to_pixels(images), dr, dc) if not (dr == 0 and dc < 0) else cooccurrence.cooccurrence_of_images(images, dr, dc)
    plane = cooccurrence.cooccurrence_of_images(images, dr, dc)
    assert sorted(map(tuple, pixel.collect())) == sorted(map(tuple, plane.collect()))
    total = sum(max(0, h - abs(dr)) * max(0, w - abs(dc)) for h, w in ((5, 6), (4, 4)))
    assert sum(r.cnt for r in plane.collect()) == total


def test_quality(spark):
    a, b = RNG.integers(0, 256, (4, 5)), RNG.integers(0, 256, (4, 5))
    one, two = images_of(spark, x=a, same=a), images_of(spark, x=b, same=a)
    mse = float(((a - b) ** 2).mean())
    for got in (quality.quality_of_images(one, two), quality.quality(to_pixels(one), to_pixels(two))):
        rows = {r.image_id: r for r in got.collect()}
        assert rows["x"].mse == pytest.approx(mse) and rows["x"].psnr_db == pytest.approx(20 * math.log10(255 / math.sqrt(mse)))
        assert rows["same"].psnr_db == math.inf
    told = documents.documents(quality.quality_of_images(one, two), documents.quality_layout(), documents.fixed(12))
    found = {r.image_id: json.loads(r.json) for r in told.collect()}
    assert found["same"]["psnr_db"] == "inf" and found["x"]["mse"] == pytest.approx(mse)
    for bad in (lambda: quality.quality(to_pixels(one), to_pixels(images_of(spark, x=b[:3], same=a))).collect(), lambda: quality.quality_of_images(one, images_of(spark, x=b[:3], same=a)).collect()):
        with pytest.raises(Exception, match="different sizes"):
            bad()


def test_both_forms_of_windows_agree(spark):
    images = images_of(spark, a=RNG.integers(0, 256, (9, 7)), b=RNG.integers(0, 256, (5, 5)))
    kernel, cross = kernels.laplacian(3, "eight"), [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    as_set = lambda df: {(r.image_id, r.y, r.x): r.v for r in df.collect()}
    assert as_set(to_pixels(filters.convolve(images, kernel))) == as_set(filters.convolve_pixels(to_pixels(images), kernel))
    for name in ("erosion", "dilation"):
        assert as_set(to_pixels(filters.morphology(images, cross, name))) == as_set(filters.extreme_pixels(to_pixels(images), cross, name))
    found = filters.response(images, kernel)
    edges = filters.zero_crossings_pixels(found, filters.zero_crossing_threshold(found))
    limits = {r.image_id: r.threshold for r in filters.zero_crossing_threshold(found).collect()}
    wanted = {n: planes.zero_crossings(planes.correlate(p, kernel), limits[n]) for n, p in planes_back(images).items()}
    assert as_set(edges) == {(n, y, x): v for n, e in wanted.items() for (y, x), v in np.ndenumerate(e)}
    assert {r.image_id: r.edge_pixels for r in filters.count_edges(edges).collect()} == {n: np.count_nonzero(e) for n, e in wanted.items()}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic"])
def test_rotation_forms_agree(spark, method):
    images = images_of(spark, a=RNG.integers(0, 256, (9, 7)), b=RNG.integers(0, 256, (5, 11)))
    got = {(r.image_id, r.y, r.x): r.v for r in filters.rotate_pixels(to_pixels(images), 37.0, method, 5).collect()}
    wanted = {(n, y, x): int(v) for n, p in planes_back(filters.rotate(images, 37.0, method, 5)).items() for (y, x), v in np.ndenumerate(p)}
    assert got == wanted


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic"])
def test_rotation_without_a_canvas(spark, method):
    images = images_of(spark, a=RNG.integers(0, 256, (9, 7)), one=np.array([[3]]), long=RNG.integers(0, 256, (300, 2)))
    for degrees in (37.0, 90, 0, -45, 180.0000001):
        got = filters.rotate_to_pixels(images, degrees, method, 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, to_pixels(filters.rotate(images, degrees, method, 5)).collect()))


def long_orders(tmp_path, spark):
    """Orders that make an image of one column, whose turned canvas has more places than a value may have bytes; places of the image there."""
    n = 70_600
    spark.range(n).selectExpr("id * 100 AS o_orderkey", "200.5D AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    height, width = planes.rotated_box(n, 1, 30)[2:]
    assert height * width > 1 << 31
    return height * width, sum(int((v > 0).sum()) for *_, v in planes.rotated_lines(np.full((n, 1), 200, np.uint8), 30, "nearest"))


@pytest.mark.parametrize("name", ["rotate_nearest", "rotate_nearest_pixels"])
def test_rotation_of_a_long_image(spark, tmp_path, name):
    places, shown = long_orders(tmp_path, spark)
    r = catalog.QUERIES[name](spark, str(tmp_path)).agg(F.count("*").alias("n"), F.sum("v").alias("v")).first()
    assert (r.n, r.v) == (places, 200 * shown)


def shuffled(spark) -> dict[int, int]:
    """Rows that each stage so far has written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {(stage := stages.apply(i)).stageId(): stage.shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize(("method", "taps"), [("nearest", 1), ("bilinear", 4)])
def test_only_places_over_the_image_are_shuffled(spark, method, taps):
    n = 3000
    height, width = planes.rotated_box(n, 2, 30)[2:]
    pixels = spark.range(2 * n).selectExpr("'long' AS image_id", "cast(id div 2 AS int) AS y", "cast(id % 2 AS int) AS x", "cast(7 AS smallint) AS v")
    before = shuffled(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert filters.rotate_pixels(pixels, 30, method, 3).agg(F.count("*")).first()[0] == height * width > 3_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rows = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert 2 * n < rows < 2 * height + (2 + taps) * 4 * n


def test_canvas_that_no_row_holds(spark):
    with pytest.raises(Exception, match="rotate_to_pixels"):
        filters.rotate(images_of(spark, long=np.ones((70_600, 1))), 30, "nearest").collect()


def test_spectrum_of_pixels(spark):
    images = images_of(spark, a=RNG.integers(0, 256, (9, 12)))
    key = lambda df: {(r.v, r.u): complex(r.re, r.im) for r in df.collect()}
    whole, lines = key(fourier.image_spectrum(images)), key(fourier.image_spectrum_pixels(to_pixels(images), 16))
    assert whole.keys() == lines.keys() and all(abs(whole[k] - lines[k]) < 1e-6 for k in whole)
    with pytest.raises(ValueError):
        fourier.image_spectrum_pixels(to_pixels(images), 12)


def test_operators_without_rows(spark):
    none = spark.createDataFrame([], IMAGES)
    assert filters.low_pass(none, 3).count() == filters.rotate(none, 30).count() == to_pixels(none).count() == 0
    assert statistics.statistics(to_pixels(none)).count() == statistics.otsu(to_pixels(none)).count() == 0
    assert to_images(spark.createDataFrame([], PIXELS)).count() == 0
    assert filters.convolve_pixels(spark.createDataFrame([], PIXELS), kernels.average(3)).count() == 0


def test_pixels_that_are_not_a_rectangle(spark):
    for rows in ([("a", 0, 0, 1), ("a", 1, 1, 2)], [("a", 0, 0, 1), ("a", 0, 0, 2)]):
        with pytest.raises(Exception, match="not every pixel"):
            to_images(spark.createDataFrame(rows, PIXELS)).collect()


def test_wrong_parameters(spark):
    images = images_of(spark, a=np.zeros((4, 4)))
    for bad in (lambda: filters.low_pass(images, 4), lambda: filters.rotate(images, math.nan), lambda: filters.morphology(images, [[1]], "melt"), lambda: filters.rank_filter(images, [[1]], 3), lambda: experiments.add_noise(images, "pink", 1.0), lambda: blocks.PageOptions(blur_size=4), lambda: blocks.PageOptions(sharpen_amount=-1.0), lambda: fourier.signal_dft(images, 48)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="larger than the image"):
        filters.low_pass(images, 5).collect()


def test_components_and_circles(spark):
    yy, xx = np.mgrid[:40, :60]
    plane = np.where((yy - 18) ** 2 + (xx - 18) ** 2 <= 144, 255, 0) | np.where((yy < 20) & (xx > 40) & (xx < 44), 128, 0)
    images = images_of(spark, a=plane, none=np.zeros((3, 3)), all=np.full((2, 3), 1))
    found = {(r.image_id, r.label): r for r in components.components(components.labels(images)).collect()}
    assert set(found) == {("a", 1), ("a", 2), ("all", 1)} or set(found) == {("a", 1), ("a", 2), ("all", 1)}
    disc = found["a", 2] if found["a", 1].max_x < 44 and found["a", 1].min_x > 40 else found["a", 1]
    assert (disc.centroid_x, disc.centroid_y) == (18.0, 18.0) and disc.mu11 == pytest.approx(0)
    assert (found["all", 1].area, found["all", 1].mu20, found["all", 1].mu02) == (6, 4.0, 1.5)
    round_ones = components.round_components(components.components(components.labels(images))).collect()
    assert [(r.image_id, r.area) for r in round_ones] == [("a", disc.area)]
    chosen = components.round_components(components.components(components.labels(images)))
    colours = {(r.r, r.g, r.b) for r in components.label_colours(components.labels(images), chosen).where("image_id = 'a'").collect()}
    assert (55, 55, 55) in colours and len(colours) == 2
    assert components.label_pictures(images).count() == plane.size + 9 + 6


def brute_blocks(plane, size):
    """Features of each block by loops over its pixels."""
    out = {}
    for r in range(0, plane.shape[0], size):
        for c in range(0, plane.shape[1], size):
            block = plane[r : r + size, c : c + size].astype(int)
            low, high = block.min(), block.max()
            w = ((block - low) * 255 + (high - low) // 2) // (high - low) if high > low else block
            dark = (w <= 85).sum(axis=1)
            share, active = dark / block.shape[1], (dark >= max(1.0, 0.08 * block.shape[1])).mean()
            score = 0.0 if not 0.08 <= active <= 0.90 else math.sqrt(max(0.0, (share**2).mean() - share.mean() ** 2)) * (1 - abs(active - 0.45))
            out[r // size, c // size] = [(block >= 245).mean(), (block <= 128).mean(), (block < 245).mean(), ((block >= 64) & (block < 245)).mean(), (w >= 205).mean(), (w <= 85).mean(), ((w >= 80) & (w < 205)).mean(), score, block.mean(), block.var()]
    return out


def test_blocks_against_loops(spark):
    plane = np.full((37, 45), 255)
    plane[10:32, 5:33] = RNG.integers(30, 220, (22, 28))
    plane[33:35, 2:40] = 10
    images = images_of(spark, p=plane)
    got = {(r.row, r.col): [r[f] for f in blocks.FEATURES] for r in blocks.features(to_pixels(images), 8).collect()}
    wanted = brute_blocks(plane, 8)
    assert got.keys() == wanted.keys()
    for k, v in wanted.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_restoration_leaves_the_rest_alone(spark):
    plane = np.full((64, 64), 255)
    plane[16:48, 16:48] = RNG.integers(40, 200, (32, 32))
    images = images_of(spark, p=plane, blank=np.full((20, 20), 255))
    options = blocks.PageOptions(block_size=8, min_region_blocks=4, padding=0.25)
    page = experiments.page(images, options)
    box = page["boxes"].where("image_id = 'p'").collect()
    assert [(r.block_count, r.x, r.y, r.width, r.height) for r in box] == [(16, 14, 14, 36, 36)]
    assert [(r.block_count, r.x, r.y, r.width, r.height) for r in page["regions"].collect()] == [(16, 16, 16, 32, 32)]
    restored = planes_back(page["restored"])
    mask = np.zeros((64, 64), bool)
    mask[14:50, 14:50] = True
    wanted = planes.masked_sharpen(planes.masked_blur(plane.astype(np.uint8), mask, kernels.gaussian(11, 1.8)), mask, 0.35)
    assert np.array_equal(restored["p"], wanted) and (restored["blank"] == 255).all()
    tinted = blocks.overlays(images, blocks.image_blocks(page["blocks"])).where("image_id = 'p' and (r <> g)").count()
    assert tinted > 0


def test_small_regions_fall_back(spark):
    plane = np.full((32, 32), 255)
    plane[8:16, 8:16] = RNG.integers(40, 200, (8, 8))
    merged = blocks.merge(blocks.classify(to_pixels(images_of(spark, p=plane)), 8), 2, 1)
    assert {r["class"] for r in merged.collect()} == {"background", "text"} and blocks.regions(merged).count() == 0
    kept = blocks.merge(blocks.classify(to_pixels(images_of(spark, p=plane)), 8), 1, 0)
    assert [(r.id, r.block_count) for r in blocks.regions(kept).collect()] == [(0, 1)]


def test_signals(spark):
    rows = [("a", k, float(v)) for k, v in enumerate(RNG.normal(size=5))] + [("b", 0, 2.0)]
    signals = spark.createDataFrame(rows, "signal_id string, idx int, value double")
    found = {}
    for r in fourier.signal_spectrum(signals).collect():
        found.setdefault(r.signal_id, {})[r.k] = complex(r.re, r.im)
    assert np.array([found["a"][k] for k in range(8)]) == pytest.approx(np.fft.fft([v for _, _, v in rows[:5]], 8))
    assert found["b"] == {0: 2 + 0j}
    assert fourier.signal_plots(signals, width=20, height=10).count() == fourier.signal_spectrum_images(signals).count() == 2


def test_reports(spark):
    images = images_of(spark, a=RNG.integers(0, 256, (12, 14)), b=RNG.integers(0, 256, (9, 9)))
    low = {r.image_id: r for r in experiments.low_pass_report(images, "gaussian", 100.0, 3, threshold=5.0).collect()}
    assert (low["a"].width, low["a"].height) == (12, 10) and low["a"].noisy_mse > 0
    back = planes_back(images)
    noisy = planes.impulse_noise(back["b"], 0.2, 1)
    rank = {r.image_id: r for r in experiments.rank_report(images, "impulse", 0.2, [[1] * 3] * 3, 4).collect()}
    median = planes.rank_filter(noisy, np.ones((3, 3), bool), 4).astype(int)
    assert rank["b"].median_mse == pytest.approx(((median - back["b"][1:-1, 1:-1]) ** 2).mean())
    turned = experiments.rotation_report(images, 0.0, timed=True).collect()
    assert len(turned) == 6 and all(r.mse == 0 and r.psnr_db == math.inf and r.rotation_ms >= 0 for r in turned)

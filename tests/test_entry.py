"""The driver's contract, the command line and streams."""

import json
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rasterloom import cli
from rasterloom.functions import kernels, planes
from rasterloom.plans import catalog
from rasterloom.sources import documents, formats
from rasterloom.streaming.images import stream_images, write_stream

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("orders", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    cursor = tables.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(row[names.index(c)]) for c in columns]) for row in cursor.fetchall())


def test_pixel_spectrum_is_of_the_whole_table(spark):
    found = catalog.QUERIES["image_fft_pixels"](spark, SF).groupBy("image_id").count().collect()
    assert len(found) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and {r["count"] for r in found} == {64}


@pytest.fixture
def files(tmp_path):
    plane = np.random.default_rng(5).integers(0, 256, (20, 24)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(formats.encode_png(plane))
    (tmp_path / "b.pgm").write_bytes(formats.encode_pgm(255 - plane))
    (tmp_path / "signal.txt").write_text(" ".join(map(str, range(16))))
    (tmp_path / "kernel.txt").write_text("0 -1 0\n-1 5 -1\n0 -1 0\n")
    (tmp_path / "aperture.txt").write_text("0 1 0\n1 1 1\n0 1 0\n")
    return tmp_path


COMMANDS = [
    "info --input {d}/a.png",
    "lab1 stats --input {d}/a.png --output {d}/o.json --histogram-output {d}/o.png",
    "lab1 glcm --input {d}/a.png --output {d}/o.json --dr 1 --dc 0 --matrix-output {d}/o.png",
    "lab1 noise --input {d}/a.png --output {d}/o.png --variance 9",
    "lab1 psnr --original {d}/a.png --distorted {d}/b.pgm --output {d}/o.json",
    "lab2 signal-plot --input {d}/signal.txt --output {d}/o.png",
    "lab2 signal-spectrum --input {d}/signal.txt --output {d}/o.png",
    "lab2 image-spectrum --input {d}/a.png --output {d}/o.png",
    "lab3 rotate --input {d}/a.png --output {d}/o.png --angle 30 --method bicubic",
    "lab3 compare --input {d}/a.png --output {d}/o.json --angle 30",
    "lab4 convolve --input {d}/a.png --output {d}/o.png --kernel {d}/kernel.txt",
    "lab4 threshold-lowpass --input {d}/a.png --output {d}/o.png --kernel-size 3 --threshold 5",
    "lab4 lowpass-denoise --input {d}/a.png --noise gaussian --variance 25 --kernel-size 3 --noisy-output {d}/n.png --filtered-output {d}/o.png --metrics-output {d}/o.json",
    "lab4 laplacian --input {d}/a.png --output {d}/o.png --kernel eight",
    "lab4 log-filter --input {d}/a.png --output {d}/o.png --kernel-size 5 --sigma 1",
    "lab4 zero-crossing --input {d}/a.png --output {d}/o.png --kernel-size 5 --sigma 1 --metrics-output {d}/o.json",
    "lab4 sharpen --input {d}/a.png --output {d}/o.png",
    "lab5 rank --input {d}/a.png --output {d}/o.png --aperture {d}/aperture.txt --rank median",
    "lab5 trimmed-mean --input {d}/a.png --output {d}/o.png --aperture {d}/aperture.txt --trimmed-count 2",
    "lab5 morphology --input {d}/a.png --output {d}/o.png --aperture {d}/aperture.txt --operation opening",
    "lab5 compare-denoise --input {d}/a.png --noise impulse --probability 0.1 --aperture {d}/aperture.txt --trimmed-count 2 --noisy-output {d}/n.png --median-output {d}/m.png --trimmed-output {d}/o.png --metrics-output {d}/o.json",
    "lab6 otsu --input {d}/a.png --output {d}/o.png --metrics-output {d}/o.json",
    "lab6 components --input {d}/a.png --output {d}/o.png --metrics-output {d}/o.json",
    "lab6 circles --input {d}/a.png --output {d}/o.png --metrics-output {d}/o.json",
    "homework read-tiff --input {d}/b.pgm --output {d}/o.png",
    "homework classify-blocks --input {d}/a.png --output {d}/o.png --block-size 8 --min-region-blocks 1 --metrics-output {d}/o.json",
    "homework restore-halftone --input {d}/a.png --output {d}/o.png --blurred-output {d}/b.png --blocks-output {d}/c.png --metrics-output {d}/o.json",
]


def test_all_commands_are_listed():
    assert {tuple(c.split(" --")[0].split()) for c in COMMANDS} == set(cli.COMMANDS)


def psnr(mse):
    return 20 * math.log10(255 / math.sqrt(mse)) if mse else math.inf


def mean_square(a, b):
    return float(((a.astype(int) - b) ** 2).mean())


def shown(plane, command, made):
    """What the pictures of a command must be, by the functions of a plane; None where the document tells it."""
    full, cross = np.ones((3, 3), bool), np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    log = kernels.laplacian_of_gaussian(5, 1.0)
    response = planes.correlate(plane, log)
    return {
        "lab1 noise": lambda: planes.gaussian_noise(plane, 9.0, 1),
        "lab2 signal-plot": lambda: planes.signal_plot(np.arange(16.0)),
        "lab2 signal-spectrum": lambda: planes.signal_spectrum_image(np.arange(16.0)),
        "lab2 image-spectrum": lambda: planes.plane_spectrum_image(plane),
        "lab3 rotate": lambda: planes.rotate(plane, 30, "bicubic"),
        "lab4 convolve": lambda: planes.to_pixels(planes.correlate(plane, np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], float))),
        "lab4 threshold-lowpass": lambda: planes.threshold_low_pass(plane, kernels.average(3), 5.0),
        "lab4 lowpass-denoise": lambda: planes.to_pixels(planes.correlate(planes.gaussian_noise(plane, 25.0, 1), kernels.average(3))),
        "lab4 laplacian": lambda: planes.magnitude(planes.correlate(plane, kernels.laplacian(3, "eight"))),
        "lab4 log-filter": lambda: planes.magnitude(response),
        "lab4 zero-crossing": lambda: planes.zero_crossings(response, planes.zero_crossing_threshold(response)),
        "lab4 sharpen": lambda: planes.to_pixels(planes.correlate(plane, kernels.sharpening(5, 1.0))),
        "lab5 rank": lambda: planes.rank_filter(plane, cross, 2),
        "lab5 trimmed-mean": lambda: planes.trimmed_mean(plane, cross, 2),
        "lab5 morphology": lambda: planes.morphology(plane, cross, "opening"),
        "lab5 compare-denoise": lambda: planes.trimmed_mean(planes.impulse_noise(plane, 0.1, 1), cross, 2),
        "lab6 otsu": lambda: np.where(plane <= made.get("threshold", 0), 0, 255),
        "lab6 components": lambda: planes.label_colours(planes.label_components(plane > 0)),
        "homework read-tiff": lambda: np.repeat((255 - plane)[..., None], 3, axis=2),
    }.get(command)


#: Keys of each document, in order.
KEYS = {
    "lab1 stats": "input width height channels pixel_type mean variance quartiles entropy energy skewness kurtosis histogram",
    "lab1 glcm": "input width height row_offset column_offset total_pairs energy matrix",
    "lab1 psnr": "original distorted width height mse psnr_db",
    "lab3 compare": "input angle_degrees quality_method original_width original_height methods",
    "lab4 lowpass-denoise": "input noisy_output filtered_output noise_type variance seed filter original_width original_height comparison_width comparison_height comparison_method noisy_mse noisy_psnr_db filtered_mse filtered_psnr_db",
    "lab4 zero-crossing": "input edge_output method kernel_width kernel_height sigma threshold threshold_method original_width original_height edge_width edge_height edge_pixels",
    "lab5 compare-denoise": "input noisy_output median_output trimmed_mean_output noise_type probability seed aperture median_filter trimmed_mean_filter original_width original_height comparison_width comparison_height comparison_method noisy_mse noisy_psnr_db median_mse median_psnr_db trimmed_mean_mse trimmed_mean_psnr_db",
    "lab6 otsu": "input binary_output method width height threshold class_0 class_1 within_class_variance between_class_variance",
    "lab6 components": "input labels_output method foreground_condition width height component_count components",
    "lab6 circles": "input highlighted_output method foreground_condition width height component_count selected_count criteria selected_components",
    "homework classify-blocks": "input overlay_output width height block_size grid_width grid_height method postprocessing legend counts image_regions blocks",
    "homework restore-halftone": "input restored_output blurred_output blocks_output width height options processing_mask processed_region_count image_region_count image_regions",
}


def told(plane, command):
    """Figures of a document, computed plainly."""
    inner = plane[1:-1, 1:-1]
    noisy, hit = planes.gaussian_noise(plane, 25.0, 1), planes.impulse_noise(plane, 0.1, 1)
    return {
        "lab1 stats": {"mean": plane.mean(), "variance": plane.var(), "histogram": np.bincount(plane.ravel(), minlength=256).tolist()},
        "lab1 psnr": {"mse": mean_square(plane, 255 - plane), "psnr_db": psnr(mean_square(plane, 255 - plane))},
        "lab1 glcm": {"total_pairs": 19 * 24, "row_offset": 1},
        "lab4 lowpass-denoise": {"noisy_mse": mean_square(inner, noisy[1:-1, 1:-1]), "filtered_mse": mean_square(inner, planes.to_pixels(planes.correlate(noisy, kernels.average(3)))), "comparison_width": 22},
        "lab5 compare-denoise": {"noisy_mse": mean_square(inner, hit[1:-1, 1:-1]), "comparison_height": 18},
        "lab6 components": {"component_count": int(planes.label_components(plane > 0).max())},
        "lab6 circles": {"component_count": int(planes.label_components(plane > 0).max())},
        "homework classify-blocks": {"grid_width": 3, "grid_height": 3},
    }.get(command, {})


@pytest.mark.parametrize("command", COMMANDS)
def test_command(spark, files, command, capsys):
    plane = formats.decode((files / "a.png").read_bytes())
    words = command.format(d=files).split()
    assert cli.main(words, spark) == 0
    name = " ".join(w for w in words[:2] if not w.startswith("--"))
    made = {}
    for flag, path in zip(words, words[1:], strict=False):
        if flag.endswith("output") and path.endswith("json"):
            made = json.loads((files / path).read_text())
            assert list(made) == KEYS[name].split()
            assert made.get("input", made.get("original")) == str(files / "a.png")
            for key, value in told(plane, name).items():
                assert made[key] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), key
    for flag, path in zip(words, words[1:], strict=False):
        if flag.endswith("output") and path.endswith("png"):
            picture = formats.decode((files / path).read_bytes())
            wanted = shown(plane, name, made)
            if wanted is not None and path.endswith("o.png"):
                assert np.array_equal(picture, wanted())
            assert picture.size > 0
    if name == "info":
        assert "width: 24" in capsys.readouterr().out


def test_pictures_are_written_as_their_ending_says(spark, files):
    plane = formats.decode((files / "a.png").read_bytes())
    for ending, magic in (("pgm", b"P5"), ("bmp", b"BM"), ("tif", b"II"), ("png", formats.PNG_MAGIC)):
        assert cli.main(["lab5", "rank", "--input", str(files / "a.png"), "--output", str(files / f"o.{ending}"), "--aperture", str(files / "aperture.txt"), "--rank", "max"], spark) == 0
        data = (files / f"o.{ending}").read_bytes()
        assert data.startswith(magic) and formats.decode_gray(data).shape == (18, 22)
    assert cli.main(["lab1", "noise", "--input", str(files / "a.png"), "--output", str(files / "o.jpg"), "--variance", "1"], spark) == 1
    assert plane.shape == (20, 24)


def test_inputs_of_one_name_keep_their_folders(spark, files, capsys):
    for k, folder in enumerate("xy"):
        (files / "in" / folder).mkdir(parents=True)
        (files / "in" / folder / "a.png").write_bytes(formats.encode_png(np.full((4, 4), k, np.uint8)))
    arguments = ["lab3", "rotate", "--input", str(files / "in" / "*" / "*.png"), "--output", str(files / "out"), "--angle", "90"]
    assert cli.main(arguments, spark) == 0
    assert [formats.decode((files / "out" / f / "a.png").read_bytes()).max() for f in "xy"] == [0, 1]
    (files / "in" / "x" / "a.pgm").write_bytes(formats.encode_pgm(np.zeros((4, 4), np.uint8)))
    assert cli.main(["lab3", "rotate", "--input", str(files / "in" / "x"), "--output", str(files / "out"), "--angle", "90"], spark) == 1
    assert "several inputs" in capsys.readouterr().err


def test_layout_of_documents():
    """The published document of a component, letter by letter."""
    component = {"label": 1, "area": 9, "min_x": 2, "min_y": 2, "max_x": 4, "max_y": 4, "m00": 9.0, "m10": 27.0, "m01": 1234567.0, "centroid_x": 3.0, "centroid_y": 1 / 3, "mu20": 6.0, "mu02": 6.0, "mu11": 0.0}
    row = {"image_id": "in.pgm", "width": 18, "height": 14, "components": [component]}
    text = documents.written(documents.components_layout("out.png")(row), documents.significant)
    assert text.splitlines()[:16] == ["{", '  "input": "in.pgm",', '  "labels_output": "out.png",', '  "method": "4-connected component labeling",', '  "foreground_condition": "pixel != 0",', '  "width": 18,', '  "height": 14,', '  "component_count": 1,', '  "components": [', "    {", '      "label": 1,', '      "area": 9,', '      "min_x": 2,', '      "min_y": 2,', '      "max_x": 4,', '      "max_y": 4,']
    assert text.splitlines()[16:] == ['      "raw_moments": {', '        "m00": 9,', '        "m10": 27,', '        "m01": 1.23457e+06', "      },", '      "centroid": {', '        "x": 3,', '        "y": 0.333333', "      },", '      "central_moments": {', '        "mu20": 6,', '        "mu02": 6,', '        "mu11": 0', "      }", "    }", "  ]", "}"]
    assert documents.written({"a": [], "b": [1, 2], "c": math.inf, "d": 0.5}, documents.fixed(10)) == '{\n  "a": [\n  ],\n  "b": [1, 2],\n  "c": "inf",\n  "d": 0.5000000000\n}'


def test_command_errors(spark, files, capsys):
    assert cli.main(["lab9"], spark) == 2 and cli.main(["lab1", "stats"], spark) == 2
    assert cli.main(["lab4", "laplacian", "--input", "x.png", "--output", "y.png", "--kernel-size", "0"], spark) == 2
    assert cli.main(["lab1", "noise", "--input", str(files / "none.png"), "--output", "y.png", "--variance", "1"], spark) == 1
    assert "error:" in capsys.readouterr().err


def test_many_files(spark, files):
    (files / "in").mkdir()
    for name in ("a.png", "b.pgm"):
        (files / name).rename(files / "in" / name)
    assert cli.main(["lab3", "rotate", "--input", str(files / "in"), "--output", str(files / "out"), "--angle", "90"], spark) == 0
    assert {p.name for p in (files / "out").iterdir()} == {"a.png", "b.png"}


def test_stream(spark, files):
    from rasterloom.operators import filters

    (files / "bad.png").write_bytes(b"no image")
    for _ in range(2):  # a second run finds nothing new
        write_stream(stream_images(spark, str(files)), lambda images: filters.low_pass(images, 3), str(files / "out"), str(files / "check")).awaitTermination()
    got = spark.read.parquet(str(files / "out")).collect()
    assert sorted((r.width, r.height) for r in got) == [(22, 18), (22, 18)]

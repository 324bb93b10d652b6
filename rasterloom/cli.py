"""Command line: one subcommand for each operator, over one image file or many (a folder or a glob).

With many inputs, outputs are folders that hold files as the inputs lie below theirs, written by the tasks themselves. Pictures
are written as their file's ending says (PNG in folders). Exit codes: 0, 1 for errors in the data,
2 for usage.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import uuid
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.operators import blocks, components, cooccurrence, filters, fourier, quality, statistics
from rasterloom.operators.frames import info, to_images, to_pixels
from rasterloom.plans import experiments
from rasterloom.sources import documents, formats, readers, sinks
from rasterloom.sources.documents import fixed


def positive_size(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("a positive number is asked for")
    return value


def number(text: str) -> float:
    value = float(text)
    if math.isnan(value):
        raise argparse.ArgumentTypeError("a number is asked for")
    return value


def not_negative(text: str) -> float:
    value = number(text)
    if value < 0:
        raise argparse.ArgumentTypeError("a number from 0 on is asked for")
    return value


def _images(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_images(spark, path)


def _local(name: str) -> str:
    """The path of a file that Spark names by URI."""
    return unquote(urlparse(name).path)


def _targets(spark: SparkSession, source: str, output: str, ending: str) -> dict[str, str]:
    """Where each input's result goes: one file, or below a folder as the inputs lie below theirs. Only names come to the driver."""
    names = sorted(_local(r.path) for r in spark.read.format("binaryFile").load(source).select("path").collect())
    if not names:
        raise ValueError("nothing was read")
    if len(names) == 1 and not Path(output).is_dir() and not Path(source).is_dir():
        return {names[0]: output}
    root = os.path.commonpath([os.path.dirname(n) for n in names])
    found = {n: str(Path(output, os.path.relpath(n, root)).with_suffix(ending)) for n in names}
    clashing = [t for t, k in Counter(found.values()).items() if k > 1]
    if clashing:
        raise ValueError(f"several inputs would be written to {clashing[0]}")
    return found


def _write(rows: DataFrame, column: str, source: str, output: str | None, ending: str) -> None:
    """One file a row, written by the tasks that make them: the folder must be one that all machines share."""
    if output is None:
        return
    targets = _targets(rows.sparkSession, source, output, ending)

    def run(batches):
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("image_id", column)), strict=True):
                target = Path(targets[_local(name)])
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                part.write_bytes(data.encode() if isinstance(data, str) else bytes(data))
                part.replace(target)  # whole or not at all, however often a task runs
                yield pa.record_batch({"written": [str(target)]})

    written = rows.select("image_id", column).mapInArrow(run, "written string").count()
    if written != len(targets):
        raise ValueError(f"{len(targets)} inputs gave {written} outputs")


def _ending(output: str) -> str:
    """The ending of an image file, which says how it is written; PNG in folders."""
    ending = Path(output).suffix if not Path(output).is_dir() else ""
    formats.encoder(ending or ".png")
    return ending or ".png"


def _picture(images: DataFrame, source: str, output: str | None) -> None:
    if output is not None:
        _write(sinks.image_files(images, _ending(output)), "file", source, output, _ending(output))


def _picture_rgb(pixels: DataFrame, source: str, output: str | None) -> None:
    if output is not None:
        _write(sinks.image_files_rgb(pixels, _ending(output)), "file", source, output, _ending(output))


def _json(rows: DataFrame, layout, number, source: str, output: str | None) -> None:
    """Documents; a layout's strings for inputs are paths, not URIs."""
    if output is not None:
        plain = documents.documents(rows, lambda row: layout(row | {"image_id": _local(row["image_id"])}), number)
        _write(plain, "json", source, output, ".json")


def run_info(spark, a):
    for row in info(_images(spark, a.input)).toLocalIterator():
        print("\n".join(f"{k}: {v}" for k, v in row.asDict().items()))


def run_stats(spark, a):
    images = _images(spark, a.input)
    pixels = to_pixels(images)
    counts = statistics.histogram(pixels)
    listed = counts.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "cnt"))), lambda x: x["cnt"]).alias("histogram"))
    stats = statistics.from_histogram(counts)
    _json(images.select("image_id", "width", "height").join(stats, "image_id").join(listed, "image_id"), documents.statistics_layout, fixed(10), a.input, a.output)
    _picture(statistics.histogram_images(counts), a.input, a.histogram_output)


def run_glcm(spark, a):
    images = _images(spark, a.input)
    glcm = cooccurrence.cooccurrence_of_images(images, a.dr, a.dc)
    cells = glcm.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("first", "second", "cnt"))).alias("pairs"))
    _json(images.select("image_id", "width", "height").join(cooccurrence.energy(glcm), "image_id").join(cells, "image_id"), documents.cooccurrence_layout, fixed(12), a.input, a.output)
    if a.matrix_output is not None:
        _picture(to_images(cooccurrence.rendered(glcm)), a.input, a.matrix_output)


def run_noise(spark, a):
    _picture(filters.gaussian_noise(_images(spark, a.input), a.variance, a.seed), a.input, a.output)


def run_psnr(spark, a):
    name = _images(spark, a.original).select("image_id").first().image_id
    pair = [_images(spark, p).select(F.lit(name).alias("image_id"), "width", "height", "pixels") for p in (a.original, a.distorted)]
    _json(quality.quality_of_images(*pair), documents.quality_layout(a.original, a.distorted), fixed(12), a.original, a.output)


def run_signal_plot(spark, a):
    _picture(fourier.signal_plots(readers.read_signals(spark, a.input)), a.input, a.output)


def run_signal_spectrum(spark, a):
    _picture(fourier.signal_spectrum_images(readers.read_signals(spark, a.input)), a.input, a.output)


def run_image_spectrum(spark, a):
    _picture(fourier.image_spectrum_images(_images(spark, a.input)), a.input, a.output)


def run_rotate(spark, a):
    _picture(filters.rotate(_images(spark, a.input), a.angle, a.method), a.input, a.output)


def run_compare(spark, a):
    images = _images(spark, a.input)
    _json(experiments.rotation_rows(images, a.angle, timed=True), documents.rotation_layout(a.angle), fixed(12), a.input, a.output)


def run_convolve(spark, a):
    _picture(filters.convolve(_images(spark, a.input), readers.parse_kernel(readers.read_text(spark, a.kernel))), a.input, a.output)


def run_threshold_lowpass(spark, a):
    _picture(filters.threshold_low_pass(_images(spark, a.input), a.kernel_size, a.threshold), a.input, a.output)


def _noise_amount(a) -> float:
    amount = a.variance if a.noise == "gaussian" else a.probability
    if amount is None:
        raise ValueError("gaussian noise needs --variance, impulse noise --probability")
    return amount


def run_lowpass_denoise(spark, a):
    images, amount = _images(spark, a.input), _noise_amount(a)
    noisy = experiments.add_noise(images, a.noise, amount, a.seed)
    _picture(noisy, a.input, a.noisy_output)
    _picture(filters.low_pass(noisy, a.kernel_size) if a.threshold is None else filters.threshold_low_pass(noisy, a.kernel_size, a.threshold), a.input, a.filtered_output)
    layout = documents.low_pass_layout(a.noise, amount, a.seed, a.kernel_size, a.threshold, noisy=a.noisy_output, filtered=a.filtered_output)
    _json(experiments.low_pass_report(images, a.noise, amount, a.kernel_size, threshold=a.threshold, seed=a.seed), layout, fixed(12), a.input, a.metrics_output)


def run_laplacian(spark, a):
    _picture(filters.laplacian(_images(spark, a.input), a.kernel_size, a.kernel), a.input, a.output)


def run_log_filter(spark, a):
    _picture(filters.laplacian_of_gaussian(_images(spark, a.input), a.kernel_size, a.sigma), a.input, a.output)


def run_zero_crossing(spark, a):
    images = _images(spark, a.input)
    _picture(filters.zero_crossing(images, a.kernel_size, a.sigma), a.input, a.output)
    told = filters.zero_crossing_report(images, a.kernel_size, a.sigma).withColumns({"kernel_size": F.lit(a.kernel_size), "sigma": F.lit(float(a.sigma))})
    sized = images.select("image_id", F.col("width").alias("original_width"), F.col("height").alias("original_height"))
    _json(sized.join(told, "image_id"), documents.zero_crossing_layout(a.output), fixed(12), a.input, a.metrics_output)


def run_sharpen(spark, a):
    _picture(filters.sharpen(_images(spark, a.input), a.kernel_size, a.amount), a.input, a.output)


def _aperture(spark, a):
    return readers.parse_aperture(readers.read_text(spark, a.aperture))


def run_rank(spark, a):
    _picture(filters.rank_filter(_images(spark, a.input), _aperture(spark, a), a.rank), a.input, a.output)


def run_trimmed_mean(spark, a):
    _picture(filters.trimmed_mean(_images(spark, a.input), _aperture(spark, a), a.trimmed_count), a.input, a.output)


def run_morphology(spark, a):
    _picture(filters.morphology(_images(spark, a.input), _aperture(spark, a), a.operation), a.input, a.output)


def run_compare_denoise(spark, a):
    images, mask, amount = _images(spark, a.input), _aperture(spark, a), _noise_amount(a)
    noisy = experiments.add_noise(images, a.noise, amount, a.seed)
    _picture(noisy, a.input, a.noisy_output)
    _picture(filters.rank_filter(noisy, mask, "median"), a.input, a.median_output)
    _picture(filters.trimmed_mean(noisy, mask, a.trimmed_count), a.input, a.trimmed_output)
    layout = documents.rank_layout(a.noise, amount, a.seed, mask.astype(int).tolist(), a.trimmed_count, noisy=a.noisy_output, median=a.median_output, trimmed_mean=a.trimmed_output)
    _json(experiments.rank_report(images, a.noise, amount, mask, a.trimmed_count, seed=a.seed), layout, fixed(12), a.input, a.metrics_output)


def run_otsu(spark, a):
    images = _images(spark, a.input)
    pixels = to_pixels(images)
    _picture(to_images(statistics.otsu_binarize(pixels)), a.input, a.output)
    _json(images.select("image_id", "width", "height").join(statistics.otsu(pixels), "image_id"), documents.otsu_layout(a.output), fixed(12), a.input, a.metrics_output)


def run_components(spark, a):
    images = _images(spark, a.input)
    _picture_rgb(components.label_pictures(images), a.input, a.output)
    found = sinks.nested(components.components(components.labels(images)), "components")
    _json(images.select("image_id", "width", "height").join(found, "image_id", "left"), documents.components_layout(a.output), documents.significant, a.input, a.metrics_output)


def run_circles(spark, a):
    images = _images(spark, a.input)
    labelled = components.labels(images)
    every = components.components(labelled)
    found = components.round_components(every)
    painted = components.label_colours(labelled, found)
    black = to_pixels(images).select("image_id", "y", "x")
    whole = black.join(painted, ["image_id", "y", "x"], "left").na.fill(0, ["r", "g", "b"])
    _picture_rgb(whole, a.input, a.output)
    counts = every.groupBy("image_id").agg(F.count("*").alias("component_count"))
    rows = images.select("image_id", "width", "height").join(counts, "image_id", "left").join(sinks.nested(found, "circles"), "image_id", "left")
    _json(rows, documents.circles_layout(components.MIN_AREA, components.ROUNDNESS, a.output), fixed(12), a.input, a.metrics_output)


def run_read_tiff(spark, a):
    _picture_rgb(readers.read_rgb(spark, a.input), a.input, a.output)


def _options(a) -> blocks.PageOptions:
    return blocks.PageOptions(block_size=a.block_size, min_region_blocks=a.min_region_blocks, min_neighbors=a.min_neighbors)


def run_classify_blocks(spark, a):
    images = _images(spark, a.input)
    page = experiments.page(images, _options(a))
    _picture_rgb(blocks.overlays(images, blocks.image_blocks(page["blocks"])), a.input, a.output)
    _json(experiments.page_rows(images, page), documents.blocks_layout(a.block_size, a.min_region_blocks, a.min_neighbors, a.output), fixed(10), a.input, a.metrics_output)


def run_restore_halftone(spark, a):
    images, options = _images(spark, a.input), blocks.PageOptions()
    page = experiments.page(images, options)
    _picture(page["restored"], a.input, a.output)
    if a.blurred_output is not None:
        from dataclasses import replace

        _picture(blocks.restore(images, page["boxes"], replace(options, sharpen_amount=0.0)), a.input, a.blurred_output)
    if a.blocks_output is not None:
        _picture_rgb(blocks.overlays(images, page["boxes"]), a.input, a.blocks_output)
    rows = images.select("image_id", "width", "height").join(sinks.nested(page["regions"], "regions"), "image_id", "left")
    _json(rows, documents.restoration_layout(options, a.output, a.blurred_output, a.blocks_output), fixed(10), a.input, a.metrics_output)


INPUT, OUTPUT = ("--input", {"required": True}), ("--output", {"required": True})
SIZE, SEED = ("--kernel-size", {"type": positive_size, "required": True}), ("--seed", {"type": int, "default": 1})
METRICS = ("--metrics-output", {})
NOISE = [("--noise", {"choices": ("gaussian", "impulse"), "required": True}), ("--variance", {"type": not_negative}), ("--probability", {"type": not_negative}), SEED, ("--noisy-output", {"required": True})]
APERTURE, TRIMMED = ("--aperture", {"required": True}), ("--trimmed-count", {"type": int, "required": True})
SIGMA, ANGLE = ("--sigma", {"type": number, "required": True}), ("--angle", {"type": number, "required": True})
GRID = [("--block-size", {"type": positive_size, "default": 56}), ("--min-region-blocks", {"type": positive_size, "default": 12}), ("--min-neighbors", {"type": positive_size, "default": 1})]

COMMANDS = {
    ("info",): (run_info, [INPUT]),
    ("lab1", "stats"): (run_stats, [INPUT, OUTPUT, ("--histogram-output", {})]),
    ("lab1", "glcm"): (run_glcm, [INPUT, OUTPUT, ("--dr", {"type": int, "required": True}), ("--dc", {"type": int, "required": True}), ("--matrix-output", {})]),
    ("lab1", "noise"): (run_noise, [INPUT, OUTPUT, ("--variance", {"type": not_negative, "required": True}), SEED]),
    ("lab1", "psnr"): (run_psnr, [("--original", {"required": True}), ("--distorted", {"required": True}), OUTPUT]),
    ("lab2", "signal-plot"): (run_signal_plot, [INPUT, OUTPUT]),
    ("lab2", "signal-spectrum"): (run_signal_spectrum, [INPUT, OUTPUT]),
    ("lab2", "image-spectrum"): (run_image_spectrum, [INPUT, OUTPUT]),
    ("lab3", "rotate"): (run_rotate, [INPUT, OUTPUT, ANGLE, ("--method", {"choices": ("nearest", "bilinear", "bicubic"), "default": "bilinear"})]),
    ("lab3", "compare"): (run_compare, [INPUT, OUTPUT, ANGLE]),
    ("lab4", "convolve"): (run_convolve, [INPUT, OUTPUT, ("--kernel", {"required": True})]),
    ("lab4", "threshold-lowpass"): (run_threshold_lowpass, [INPUT, OUTPUT, SIZE, ("--threshold", {"type": not_negative, "required": True})]),
    ("lab4", "lowpass-denoise"): (run_lowpass_denoise, [INPUT, SIZE, ("--threshold", {"type": not_negative}), *NOISE, ("--filtered-output", {"required": True}), ("--metrics-output", {"required": True})]),
    ("lab4", "laplacian"): (run_laplacian, [INPUT, OUTPUT, ("--kernel", {"choices": ("four", "eight"), "default": "four"}), ("--kernel-size", {"type": positive_size, "default": 3})]),
    ("lab4", "log-filter"): (run_log_filter, [INPUT, OUTPUT, SIZE, SIGMA]),
    ("lab4", "zero-crossing"): (run_zero_crossing, [INPUT, OUTPUT, SIZE, SIGMA, METRICS]),
    ("lab4", "sharpen"): (run_sharpen, [INPUT, OUTPUT, ("--kernel-size", {"type": positive_size, "default": 5}), ("--amount", {"type": not_negative, "default": 1.0})]),
    ("lab5", "rank"): (run_rank, [INPUT, OUTPUT, APERTURE, ("--rank", {"required": True})]),
    ("lab5", "trimmed-mean"): (run_trimmed_mean, [INPUT, OUTPUT, APERTURE, TRIMMED]),
    ("lab5", "morphology"): (run_morphology, [INPUT, OUTPUT, APERTURE, ("--operation", {"choices": sorted(kernels.MORPHOLOGY), "required": True})]),
    ("lab5", "compare-denoise"): (run_compare_denoise, [INPUT, APERTURE, TRIMMED, *NOISE, ("--median-output", {"required": True}), ("--trimmed-output", {"required": True}), ("--metrics-output", {"required": True})]),
    ("lab6", "otsu"): (run_otsu, [INPUT, OUTPUT, METRICS]),
    ("lab6", "components"): (run_components, [INPUT, OUTPUT, METRICS]),
    ("lab6", "circles"): (run_circles, [INPUT, OUTPUT, METRICS]),
    ("homework", "read-tiff"): (run_read_tiff, [INPUT, OUTPUT]),
    ("homework", "classify-blocks"): (run_classify_blocks, [INPUT, OUTPUT, *GRID, METRICS]),
    ("homework", "restore-halftone"): (run_restore_halftone, [INPUT, OUTPUT, ("--blurred-output", {}), ("--blocks-output", {}), METRICS]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterloom")
    subs = top.add_subparsers(required=True)
    groups = {}
    for names, (run, options) in COMMANDS.items():
        if len(names) == 2 and names[0] not in groups:
            groups[names[0]] = subs.add_parser(names[0]).add_subparsers(required=True)
        command = (subs if len(names) == 1 else groups[names[0]]).add_parser(names[-1])
        command.set_defaults(run=run)
        for flag, how in options:
            command.add_argument(flag, **how)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        arguments = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from rasterloom.session import local_session

    session = spark or local_session()
    try:
        arguments.run(session, arguments)
    except Exception as e:
        print(f"error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 1
    finally:
        if spark is None:
            session.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

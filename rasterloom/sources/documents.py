"""JSON documents of results, one an image, in the reports' layout: keys, nesting and number formats are part of it.

Numbers with a fraction get a fixed number of decimals (or six significant digits), infinite ones the string "inf". A document
is laid out in Python, where `%` formats a double by its exact value; what it is made of is aggregated before.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def fixed(digits: int) -> Callable[[float], str]:
    return lambda value: f"{value:.{digits}f}"


def significant(value: float) -> str:
    """Six significant digits, as short as they go."""
    return f"{value:g}"


def written(value, number: Callable[[float], str], depth: int = 0) -> str:
    """value as JSON: objects and lists of them over several lines, two blanks a level; lists of numbers on one line."""
    pad, inner = "  " * depth, "  " * (depth + 1)
    if isinstance(value, dict):
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k)}: {written(v, number, depth + 1)}" for k, v in value.items()) + f"\n{pad}}}"
    if isinstance(value, list):
        if value and not isinstance(value[0], (dict, list)):
            return "[" + ", ".join(written(v, number) for v in value) + "]"
        lines = ",\n".join(inner + written(v, number, depth + 1) for v in value)
        return f"[\n{lines}{chr(10) if value else ''}{pad}]"
    if isinstance(value, float):
        return '"inf"' if math.isinf(value) else number(value)
    return json.dumps(value, ensure_ascii=False)


def documents(rows: DataFrame, layout: Callable[[dict], dict], number: Callable[[float], str], *, name: str = "image_id") -> DataFrame:
    """image_id and json of rows, one an image; layout makes a row's fields the document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch({"image_id": [row[name]], "json": [written(layout(row), number) + "\n"]})

    return rows.mapInArrow(run, "image_id string, json string")


# Fixed: the keys and texts of the documents below.


def statistics_layout(row: dict) -> dict:
    head = {"input": row["image_id"], "width": row["width"], "height": row["height"], "channels": 1, "pixel_type": "uint8"}
    quartiles = {"quartiles": {q: row[q] for q in ("q1", "q2", "q3")}}
    return head | {k: row[k] for k in ("mean", "variance")} | quartiles | {k: row[k] for k in ("entropy", "energy", "skewness", "kurtosis")} | {"histogram": row["histogram"]}


def cooccurrence_layout(row: dict) -> dict:
    """pairs: (first, second, count) of those that occur."""
    matrix = [[0] * 256 for _ in range(256)]
    for pair in row["pairs"]:
        matrix[pair["first"]][pair["second"]] = pair["cnt"]
    head = {"input": row["image_id"], "width": row["width"], "height": row["height"], "row_offset": row["dr"], "column_offset": row["dc"]}
    return head | {"total_pairs": row["total_pairs"], "energy": row["energy"], "matrix": matrix}


def quality_layout(original: str | None = None, distorted: str | None = None) -> Callable[[dict], dict]:
    return lambda row: {"original": original or row["image_id"], "distorted": distorted or row["image_id"]} | {k: row[k] for k in ("width", "height", "mse", "psnr_db")}


def _noise(kind: str, amount: float, seed: int) -> dict:
    return {"noise_type": kind, "variance" if kind == "gaussian" else "probability": float(amount), "seed": seed}


def _compared(row: dict, what: str) -> dict:
    sizes = {k: row[k] for k in ("original_width", "original_height")} | {"comparison_width": row["width"], "comparison_height": row["height"]}
    return sizes | {"comparison_method": f"center crop original and noisy images to the valid {what} result size"}


def low_pass_layout(kind: str, amount: float, seed: int, size: int, threshold: float | None, *, noisy: str | None = None, filtered: str | None = None) -> Callable[[dict], dict]:
    def layout(row: dict) -> dict:
        head = {"input": row["image_id"], "noisy_output": noisy or "", "filtered_output": filtered or ""} | _noise(kind, amount, seed)
        used = {"type": "average_low_pass" if threshold is None else "thresholded_average_low_pass", "kernel_width": size, "kernel_height": size}
        used |= {} if threshold is None else {"threshold": float(threshold)}
        return head | {"filter": used} | _compared(row, "convolution") | {f"{p}_{m}": row[f"{p}_{m}"] for p in ("noisy", "filtered") for m in ("mse", "psnr_db")}

    return layout


def rank_layout(kind: str, amount: float, seed: int, aperture, trimmed: int, *, noisy: str | None = None, median: str | None = None, trimmed_mean: str | None = None) -> Callable[[dict], dict]:
    height, width, active = len(aperture), len(aperture[0]), int(sum(map(sum, aperture)))

    def layout(row: dict) -> dict:
        head = {"input": row["image_id"], "noisy_output": noisy or "", "median_output": median or "", "trimmed_mean_output": trimmed_mean or ""} | _noise(kind, amount, seed)
        filters = {"aperture": {"width": width, "height": height, "active_cells": active}, "median_filter": {"rank": active // 2}, "trimmed_mean_filter": {"trimmed_count": trimmed, "trim_each_side": trimmed // 2}}
        return head | filters | _compared(row, "aperture") | {f"{p}_{m}": row[f"{p}_{m}"] for p in ("noisy", "median", "trimmed_mean") for m in ("mse", "psnr_db")}

    return layout


def zero_crossing_layout(edges: str | None = None) -> Callable[[dict], dict]:
    def layout(row: dict) -> dict:
        head = {"input": row["image_id"], "edge_output": edges or "", "method": "LoG zero crossing", "kernel_width": row["kernel_size"], "kernel_height": row["kernel_size"]}
        level = {"sigma": row["sigma"], "threshold": row["threshold"], "threshold_method": "3 * sum(abs(I_e)) / (4 * W * H)"}
        return head | level | {k: row[k] for k in ("original_width", "original_height", "edge_width", "edge_height", "edge_pixels")}

    return layout


def otsu_layout(binary: str | None = None) -> Callable[[dict], dict]:
    def layout(row: dict) -> dict:
        head = {"input": row["image_id"], "binary_output": binary or "", "method": "Otsu thresholding"} | {k: row[k] for k in ("width", "height", "threshold")}
        of = [{"condition": f"pixel {sign} threshold", "output_value": value, "pixel_count": row[f"n{k}"], "probability": row[f"p{k}"], "mean": row[f"mean{k}"]} for k, sign, value in ((0, "<=", 0), (1, ">", 255))]
        return head | {"class_0": of[0], "class_1": of[1], "within_class_variance": row["within_var"], "between_class_variance": row["between_var"]}

    return layout


def _component(found: dict, *more: str) -> dict:
    out = {k: found[k] for k in ("label", "area", "min_x", "min_y", "max_x", "max_y", *more)}
    out |= {"raw_moments": {k: found[k] for k in ("m00", "m10", "m01")}, "centroid": {k: found[f"centroid_{k}"] for k in "xy"}}
    return out | {"central_moments": {k: found[k] for k in ("mu20", "mu02", "mu11")}}


def components_layout(labels: str | None = None) -> Callable[[dict], dict]:
    def layout(row: dict) -> dict:
        found = row["components"] or []
        head = {"input": row["image_id"], "labels_output": labels or "", "method": "4-connected component labeling", "foreground_condition": "pixel != 0"}
        return head | {"width": row["width"], "height": row["height"], "component_count": len(found), "components": [_component(c) for c in found]}

    return layout


def circles_layout(min_area: int, max_deviation: float, highlighted: str | None = None) -> Callable[[dict], dict]:
    def layout(row: dict) -> dict:
        found = row["circles"] or []
        head = {"input": row["image_id"], "highlighted_output": highlighted or "", "method": "large circle-like component detection", "foreground_condition": "pixel != 0"}
        head |= {"width": row["width"], "height": row["height"], "component_count": row["component_count"] or 0, "selected_count": len(found)}
        criteria = {"min_area_exclusive": min_area, "roundness_kr2_formula": "2 * pi * (mu20 + mu02) / S^2", "target_roundness_kr2": 1.0, "max_roundness_deviation": float(max_deviation)}
        return head | {"criteria": criteria, "selected_components": [_component(c, "roundness_kr2", "roundness_deviation") for c in found]}

    return layout


def rotation_layout(degrees: float) -> Callable[[dict], dict]:
    """methods: rows of the rotation report, with the order in which they stand."""

    def layout(row: dict) -> dict:
        each = [{"method": m["method"], "rotated_width": m["rotated_width"], "rotated_height": m["rotated_height"], "rotation_ms": m["rotation_ms"], "inverse_rotation_ms": m["inverse_rotation_ms"], "roundtrip_mse": m["mse"], "roundtrip_psnr_db": m["psnr_db"]} for m in row["methods"]]
        head = {"input": row["image_id"], "angle_degrees": float(degrees), "quality_method": "rotate by angle, rotate back by negative angle, center-crop to original size"}
        return head | {"original_width": row["width"], "original_height": row["height"], "methods": each}

    return layout


REGION = ("id", "block_count", "x", "y", "width", "height")


def blocks_layout(size: int, min_region_blocks: int, min_neighbors: int, overlay: str | None = None) -> Callable[[dict], dict]:
    from rasterloom.operators.blocks import FEATURES

    def layout(row: dict) -> dict:
        counted = {c["class"]: c["blocks"] for c in row["counts"]}
        head = {"input": row["image_id"], "overlay_output": overlay or "", "width": row["width"], "height": row["height"], "block_size": size}
        head |= {"grid_width": -(-row["width"] // size), "grid_height": -(-row["height"] // size), "method": "block histogram heuristic"}
        head |= {"postprocessing": {"connectivity": 4, "min_image_region_blocks": min_region_blocks, "min_image_neighbors": min_neighbors}}
        head |= {"legend": {"text": "unchanged", "image": "red overlay", "background": "unchanged"}, "counts": {c: counted.get(c, 0) for c in ("background", "text", "image")}}
        each = [{k: b[k] for k in ("x", "y", "width", "height", "class", "image_region_id", "image_neighbor_count", *FEATURES)} for b in row["blocks"]]
        return head | {"image_regions": [{k: r[k] for k in REGION} for r in row["regions"] or []], "blocks": each}

    return layout


def restoration_layout(options, restored: str | None = None, blurred: str | None = None, blocks: str | None = None) -> Callable[[dict], dict]:
    told = {"block_size": options.block_size, "min_region_blocks": options.min_region_blocks, "min_neighbors": options.min_neighbors, "rectangle_padding_fraction": float(options.padding)}
    told |= {"gaussian_kernel_size": options.blur_size, "gaussian_sigma": float(options.blur_sigma), "sharpen_amount": float(options.sharpen_amount)}

    def layout(row: dict) -> dict:
        found = [{k: r[k] for k in REGION} for r in row["regions"] or []]
        head = {"input": row["image_id"], "restored_output": restored or ""} | ({"blurred_output": blurred} if blurred else {}) | ({"blocks_output": blocks} if blocks else {})
        head |= {"width": row["width"], "height": row["height"], "options": told, "processing_mask": "image rectangles built without text-like boundary blocks"}
        return head | {"processed_region_count": len(found), "image_region_count": len(found), "image_regions": found}

    return layout

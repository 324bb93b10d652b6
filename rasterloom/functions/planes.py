"""Functions of one plane of pixels (a 2-D uint8 array, row 0 on top), in NumPy.

Neighbourhoods are valid ones: the border is dropped and the result is smaller by the window less one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Rows of windows that rank filters take together.
_BAND_CELLS = 1 << 22
#: Places that are turned together: few enough for a core's own cache.
_TURN_CELLS = 1 << 15


def rounded(values: np.ndarray) -> np.ndarray:
    """Values that aren't negative, rounded half up; adding a half first would lift the largest number below a half."""
    whole = np.floor(values)
    return whole + (values - whole >= 0.5)


def to_pixels(values: np.ndarray) -> np.ndarray:
    """Rounded half away from zero and cut to 0..255: negative values all become 0."""
    return rounded(np.clip(values, 0, 255)).astype(np.uint8)


def _valid(plane: np.ndarray, height: int, width: int) -> tuple[int, int]:
    h, w = plane.shape[0] - height + 1, plane.shape[1] - width + 1
    if h < 1 or w < 1:
        raise ValueError("the window is larger than the image")
    return h, w


def correlate(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The signed response: the kernel isn't flipped; cells are added in row-major order."""
    h, w = _valid(plane, *kernel.shape)
    wide = plane.astype(float)
    out = np.zeros((h, w))
    for dy in range(kernel.shape[0]):
        for dx in range(kernel.shape[1]):
            out += wide[dy : dy + h, dx : dx + w] * kernel[dy, dx]
    return out


def crop_or_pad(plane: np.ndarray, height: int, width: int, background: int = 0) -> np.ndarray:
    """The middle of the plane; offsets are halves of the differences, truncated toward zero."""
    out = np.full((height, width), background, np.uint8)
    top, left = (int((a - b) / 2) for a, b in zip(plane.shape, (height, width), strict=True))
    y, x = max(0, top), max(0, left)
    part = plane[y : top + height, x : left + width]
    out[y - top : y - top + part.shape[0], x - left : x - left + part.shape[1]] = part
    return out


def threshold_low_pass(plane: np.ndarray, kernel: np.ndarray, threshold: float) -> np.ndarray:
    """The smoothed (rounded) pixel where it differs from the original by the threshold at least, else the original."""
    if not (math.isfinite(threshold) and threshold >= 0):
        raise ValueError("the threshold must be finite and not negative")
    smooth = to_pixels(correlate(plane, kernel))
    top, left = kernel.shape[0] // 2, kernel.shape[1] // 2
    centre = plane[top : top + smooth.shape[0], left : left + smooth.shape[1]]
    return np.where(np.abs(smooth.astype(int) - centre) >= threshold, smooth, centre)


def magnitude(response: np.ndarray) -> np.ndarray:
    """Absolute responses scaled so that the largest is 255."""
    top = np.abs(response).max()
    return to_pixels(np.abs(response) * (255.0 / top)) if top > 0 else np.zeros(response.shape, np.uint8)


def zero_crossing_threshold(response: np.ndarray) -> float:
    return 3.0 * float(np.abs(response).sum()) / (4.0 * response.size)


def zero_crossings(response: np.ndarray, threshold: float) -> np.ndarray:
    """255 where one of the four neighbours has the strictly other sign and differs by the threshold at least."""
    edge = np.zeros(response.shape, bool)
    for axis in (0, 1):
        a, b = (response[:-1], response[1:]) if axis == 0 else (response[:, :-1], response[:, 1:])
        crossing = (((a < 0) & (b > 0)) | ((a > 0) & (b < 0))) & (np.abs(a - b) >= threshold)
        if axis == 0:
            edge[:-1] |= crossing
            edge[1:] |= crossing
        else:
            edge[:, :-1] |= crossing
            edge[:, 1:] |= crossing
    return np.where(edge, 255, 0).astype(np.uint8)


def _bands(plane: np.ndarray, mask: np.ndarray):
    """Stacks (active cell, row, column) of the windows, a band of rows at a time."""
    h, w = _valid(plane, *mask.shape)
    cells = np.argwhere(mask)
    rows = max(1, _BAND_CELLS // (w * len(cells)))
    for first in range(0, h, rows):
        last = min(h, first + rows)
        yield np.stack([plane[dy + first : dy + last, dx : dx + w] for dy, dx in cells])


def rank_filter(plane: np.ndarray, mask: np.ndarray, rank: int) -> np.ndarray:
    """The rank-th smallest (from 0) of the active cells."""
    n = int(mask.sum())
    if not 0 <= rank < n:
        raise ValueError(f"the rank must lie in 0..{n - 1}")
    if rank in (0, n - 1):
        h, w = _valid(plane, *mask.shape)
        pick, out = (np.minimum if rank == 0 else np.maximum), None
        for dy, dx in np.argwhere(mask):
            part = plane[dy : dy + h, dx : dx + w]
            out = part.copy() if out is None else pick(out, part, out=out)
        return out
    return np.concatenate([np.partition(band, rank, axis=0)[rank] for band in _bands(plane, mask)])


def trimmed_mean(plane: np.ndarray, mask: np.ndarray, trimmed: int) -> np.ndarray:
    """The mean of the active cells without the trimmed/2 least and greatest."""
    n = int(mask.sum())
    if trimmed < 0 or trimmed % 2 or trimmed >= n:
        raise ValueError("the trimmed count must be even and less than the active cells")
    half = trimmed // 2
    return np.concatenate([to_pixels(np.sort(band, axis=0)[half : n - half].sum(axis=0, dtype=np.int64) / (n - trimmed)) for band in _bands(plane, mask)])


def morphology(plane: np.ndarray, mask: np.ndarray, operation: str) -> np.ndarray:
    """Erosion and dilation take the minimum and maximum under the aperture, which isn't reflected."""
    top = int(mask.sum()) - 1
    ranks = {"erosion": (0,), "dilation": (top,), "opening": (0, top), "closing": (top, 0)}[operation]
    for rank in ranks:
        plane = rank_filter(plane, mask, rank)
    return plane


def rotated_box(height: int, width: int, degrees: float) -> tuple[float, float, int, int]:
    """Least x and y of the turned rectangle about its centre, and the height and width of the whole pixels it takes."""
    if not math.isfinite(degrees):
        raise ValueError("the angle must be finite")
    turn = math.radians(degrees)
    c, s = math.cos(turn), math.sin(turn)
    corners = [(x, y) for x in (-width / 2, width / 2) for y in (-height / 2, height / 2)]
    xs, ys = [x * c + y * s for x, y in corners], [-x * s + y * c for x, y in corners]
    size = [max(1, math.ceil(max(v) - min(v) - 1e-9)) for v in (ys, xs)]
    return min(xs), min(ys), size[0], size[1]


def _lagrange(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the cubic through the samples at -1, 0, 1 and 2."""
    return [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]


def turned_limits(c: float, s: float, turned_y, height, width) -> list[tuple]:
    """Between which turned x a line of the canvas can meet the plane: pairs of bounds, all of which hold, a place wider than needed.

    For arrays and for columns.
    """
    sides = ((c, turned_y * s, width), (s, -turned_y * c, height))
    return [(middle / k - (n + 1) / 2 / abs(k), middle / k + (n + 1) / 2 / abs(k)) for k, middle, n in sides if abs(k) > 1e-9]


#: Pixels of background around a plane that is turned.
_FRAME = 2


def _framed(plane: np.ndarray, background: int) -> np.ndarray:
    framed = np.full((plane.shape[0] + 2 * _FRAME, plane.shape[1] + 2 * _FRAME), background, np.uint8)
    framed[_FRAME:-_FRAME, _FRAME:-_FRAME] = plane
    return framed


def _turned(framed: np.ndarray, x: np.ndarray, y: np.ndarray, method: str, background: int) -> np.ndarray:
    """Values of places whose sources are x and y."""
    h, w = framed.shape[0] - 2 * _FRAME, framed.shape[1] - 2 * _FRAME
    stride, flat = framed.shape[1], framed.ravel()
    if method == "nearest":
        x, y = np.floor(x + 0.5), np.floor(y + 0.5)
    # only places over the plane are worked on: a turned canvas has many others
    inside = np.flatnonzero((x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1))
    band = np.full(x.shape, background, np.uint8)
    x, y = x.ravel()[inside], y.ravel()[inside]
    column, row = x.astype(np.intp), y.astype(np.intp)  # not negative, so cut off is rounded down
    at = (row + _FRAME) * stride + column + _FRAME
    if method == "nearest":
        band.ravel()[inside] = flat.take(at)
    elif method == "bilinear":
        dx, dy = x - column, y - row
        upper = flat.take(at) * (1 - dx) + flat.take(at + 1) * dx
        lower = flat.take(at + stride) * (1 - dx) + flat.take(at + stride + 1) * dx
        band.ravel()[inside] = to_pixels(upper * (1 - dy) + lower * dy)
    else:
        across, down = _lagrange(x - column), _lagrange(y - row)
        total = np.zeros(len(x))
        at -= stride + 1
        for j in range(4):
            line = across[0] * flat.take(at)
            for i in range(1, 4):
                line += across[i] * flat.take(at + i)
            total += down[j] * line
            at += stride
        band.ravel()[inside] = to_pixels(total)
    return band


def _rotation(plane: np.ndarray, degrees: float, method: str) -> tuple[float, float, int, int, float, float]:
    if method not in ("nearest", "bilinear", "bicubic"):
        raise ValueError("the method must be nearest, bilinear or bicubic")
    turn = math.radians(degrees)
    return *rotated_box(*plane.shape, degrees), math.cos(turn), math.sin(turn)


def rotate(plane: np.ndarray, degrees: float, method: str = "bilinear", background: int = 0) -> np.ndarray:
    """The plane turned about its centre (counter-clockwise on screen), on a canvas that holds all of it."""
    left, top, out_h, out_w, c, s = _rotation(plane, degrees, method)
    h, w = plane.shape
    out = np.empty((out_h, out_w), np.uint8)
    framed = _framed(plane, background)
    turned_x = left + np.arange(out_w) + 0.5
    rows = max(1, _TURN_CELLS // out_w)
    for first in range(0, out_h, rows):
        turned_y = (top + np.arange(first, min(out_h, first + rows)) + 0.5)[:, None]
        x = turned_x * c - turned_y * s + w / 2 - 0.5
        y = turned_x * s + turned_y * c + h / 2 - 0.5
        out[first : first + len(x)] = _turned(framed, x, y, method, background)
    return out


def rotated_lines(plane: np.ndarray, degrees: float, method: str = "bilinear", background: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """What rotate makes, without the canvas: bands of lines with their y, first x and number of values, and the values.

    Every line of the canvas comes once; what isn't among a line's values is background. The turned canvas of a long narrow
    plane has the square of its length, the values together are hardly more than the plane's.
    """
    left, top, out_h, out_w, c, s = _rotation(plane, degrees, method)
    h, w = plane.shape
    framed = _framed(plane, background)
    for start in range(0, out_h, _TURN_CELLS):
        lines = np.arange(start, min(out_h, start + _TURN_CELLS))
        turned_y = top + lines + 0.5
        near, far = zip(*turned_limits(c, s, turned_y, h, w), strict=True)
        first = np.clip(np.floor(np.max(near, axis=0) - left - 0.5), 0, out_w).astype(np.int64)
        count = np.clip(np.ceil(np.min(far, axis=0) - left + 0.5), first, out_w).astype(np.int64) - first
        before = np.cumsum(count) - count
        for band in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(before // _TURN_CELLS)) + 1):
            n = count[band]
            turned_x = left + (np.arange(n.sum()) + np.repeat(first[band] - before[band] + before[band[0]], n)) + 0.5
            across = np.repeat(turned_y[band], n)
            x = turned_x * c - across * s + w / 2 - 0.5
            y = turned_x * s + across * c + h / 2 - 0.5
            yield lines[band], first[band], n, _turned(framed, x, y, method, background)


def _uniforms(seed: int, n: int) -> np.ndarray:
    """The first n doubles in [0, 1) of a Mersenne twister, two 32-bit words each, the low word first."""
    twister = np.random.MT19937()
    twister._legacy_seeding(seed & 0xFFFFFFFF)
    words = twister.random_raw(2 * n)
    # nearest doubles of the 64-bit fraction; the largest stays below 1
    return np.minimum((words[0::2].astype(float) + words[1::2].astype(float) * 2.0**32) / 2.0**64, 1.0 - 2.0**-53)


def gaussian_noise(plane: np.ndarray, variance: float, seed: int = 1) -> np.ndarray:
    """Normal noise by the polar method: both values of each accepted point are used, in order."""
    if not (math.isfinite(variance) and variance >= 0):
        raise ValueError("the variance must be finite and not negative")
    wanted = (plane.size + 1) // 2
    tries = int(wanted * 1.3) + 64
    while True:
        points = -1.0 + 2.0 * _uniforms(seed, 2 * tries)
        x, y = points[0::2], points[1::2]
        s = x * x + y * y
        good = np.flatnonzero((s <= 1.0) & (s > 0.0))
        if len(good) >= wanted:
            break
        tries *= 2
    good = good[:wanted]
    scale = np.sqrt(-2.0 * np.log(s[good]) / s[good])
    normal = np.column_stack((x[good] * scale, y[good] * scale)).ravel()[: plane.size]
    return to_pixels(plane + math.sqrt(variance) * normal.reshape(plane.shape))


def impulse_noise(plane: np.ndarray, probability: float, seed: int = 1) -> np.ndarray:
    """Each pixel draws once; below the probability it draws again, for 0 or 255."""
    if not 0 <= probability <= 1:
        raise ValueError("the probability must lie in 0..1")
    u = _uniforms(seed, 2 * plane.size)
    hit = u < probability
    place = np.arange(len(u))
    # within a run of hits, tests and second draws alternate; a draw after a test that hit is a second draw
    run_start = np.maximum.accumulate(np.where(~hit, place + 1, 0))
    test_hit = hit & ((place - run_start) % 2 == 0)
    second = np.concatenate(([False], test_hit[:-1]))
    tests = np.flatnonzero(~second)[: plane.size]
    noisy = hit[tests]
    value = np.where(u[np.minimum(tests + 1, len(u) - 1)] < 0.5, 0, 255)
    return np.where(noisy, value, plane.ravel()).astype(np.uint8).reshape(plane.shape)


def fft_signal(samples: np.ndarray) -> np.ndarray:
    """The forward transform, zero-padded to a power of two, not normalised."""
    from rasterloom.functions.kernels import next_power_of_two

    return np.fft.fft(samples, next_power_of_two(len(samples)))


def fft_plane(plane: np.ndarray) -> np.ndarray:
    """The forward transform of the plane, zero-padded at the right and below to a square."""
    from rasterloom.functions.kernels import next_power_of_two

    n = next_power_of_two(max(plane.shape))
    return np.fft.fft2(plane.astype(float), (n, n))


def log_amplitude(spectrum: np.ndarray) -> np.ndarray:
    return np.log1p(np.hypot(spectrum.real, spectrum.imag))


def scaled(values: np.ndarray, top: float | None = None) -> np.ndarray:
    top = values.max() if top is None else top
    return to_pixels(values / top * 255.0) if top > 0 else np.zeros(values.shape, np.uint8)


def plane_spectrum_image(plane: np.ndarray) -> np.ndarray:
    return scaled(np.fft.fftshift(log_amplitude(fft_plane(plane))))


def signal_spectrum_image(samples: np.ndarray, width: int = 512, height: int = 256) -> np.ndarray:
    """Bars of the largest shifted log amplitude in each column's bins."""
    values = np.fft.fftshift(log_amplitude(fft_signal(samples)))
    n, columns = len(values), np.arange(width)
    begin = columns * n // width
    end = np.minimum(n, np.maximum(begin + 1, (columns + 1) * n // width))
    tops = np.array([values[a:b].max(initial=0.0) for a, b in zip(begin, end, strict=True)])
    bars = rounded(scaled(tops, values.max()) / 255.0 * height).astype(int)
    return np.where(height - 1 - np.arange(height)[:, None] < bars, 255, 0).astype(np.uint8)


def _line(x0: int, y0: int, x1: int, y1: int):
    """Integer points of a line (error-driven steps in both axes)."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    error = dx + dy
    while True:
        yield x0, y0
        if (x0, y0) == (x1, y1):
            return
        twice = 2 * error
        if twice >= dy:
            error += dy
            x0 += sx
        if twice <= dx:
            error += dx
            y0 += sy


def signal_plot(samples: np.ndarray, width: int = 512, height: int = 256) -> np.ndarray:
    """A polyline of the samples over a grey line at zero."""
    low, high = min(float(samples.min()), 0.0), max(float(samples.max()), 0.0)
    if low == high:
        low, high = low - 1.0, high + 1.0
    n = len(samples)
    ys = np.clip(rounded((high - np.append(samples, 0.0)) / (high - low) * (height - 1)), 0, height - 1).astype(int)
    xs = rounded(np.arange(n) * (width - 1) / (n - 1)).astype(int) if n > 1 else np.zeros(1, int)
    out = np.zeros((height, width), np.uint8)
    out[ys[-1]] = 64
    out[ys[0], xs[0]] = 255
    for k in range(1, n):
        for x, y in _line(int(xs[k - 1]), int(ys[k - 1]), int(xs[k]), int(ys[k])):
            out[y, x] = 255
    return out


def histogram_image(counts: np.ndarray, width: int = 512, height: int = 256) -> np.ndarray:
    """Black bars on white, one for each of the 256 bins that isn't empty."""
    if width < 256 or height < 1:
        raise ValueError("a histogram image is at least 256 pixels wide and one high")
    out = np.full((height, width), 255, np.uint8)
    top = counts.max()
    if top == 0:
        return out
    bars = np.where(counts > 0, np.clip(rounded(counts / top * height), 1, height), 0).astype(int)
    each = width // 256
    left = (width - 256 * each) // 2
    tall = np.repeat(bars, each)
    out[:, left : left + 256 * each][height - 1 - np.arange(height)[:, None] < tall] = 0
    return out


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with: roots hook to lesser roots, and paths are cut short in between."""
    root = np.arange(n)
    while True:
        at_a, at_b = root[a], root[b]
        apart = at_a != at_b
        if not apart.any():
            return root
        a, b, at_a, at_b = a[apart], b[apart], at_a[apart], at_b[apart]
        np.minimum.at(root, np.maximum(at_a, at_b), np.minimum(at_a, at_b))
        while not np.array_equal(higher := root[root], root):
            root = higher


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in the raster order of their first pixels; 0 elsewhere.

    Horizontal runs that touch across two rows are joined, so the cost follows runs and not the shapes that they form.
    """
    h, w = mask.shape
    wide = np.pad(mask, ((0, 0), (0, 1))).ravel()  # a blank ends each row, so no run goes on in the next
    edge = np.flatnonzero(np.diff(wide.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros((h, w), np.int32)
    first = np.searchsorted(ends, starts + w + 1, side="right")
    below = np.maximum(np.searchsorted(starts, ends + w + 1, side="left") - first, 0)
    upper = np.repeat(np.arange(len(starts)), below)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(below) - below - first, below)
    _, number = np.unique(_joined(len(starts), upper, lower), return_inverse=True)
    out = np.zeros(h * (w + 1), np.int32)
    out[wide] = np.repeat(number + 1, ends - starts)
    return np.ascontiguousarray(out.reshape(h, w + 1)[:, :w])


def masked_blur(plane: np.ndarray, mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Masked pixels become the weighted mean of the masked pixels under the kernel; others stay."""
    r = kernel.shape[0] // 2
    h, w = plane.shape
    values, weights = np.zeros((h, w)), np.zeros((h, w))
    inside = np.pad(mask, r)
    shown = np.pad(np.where(mask, plane, 0).astype(float), r)
    for dy in range(kernel.shape[0]):
        for dx in range(kernel.shape[1]):
            values += shown[dy : dy + h, dx : dx + w] * kernel[dy, dx]
            weights += inside[dy : dy + h, dx : dx + w] * kernel[dy, dx]
    blurred = to_pixels(np.divide(values, weights, out=plane.astype(float), where=weights > 0))
    return np.where(mask, blurred, plane)


def masked_sharpen(plane: np.ndarray, mask: np.ndarray, amount: float) -> np.ndarray:
    """Masked pixels less their four neighbours; a neighbour outside image or mask counts as the pixel itself."""
    centre = plane.astype(float)
    inside, shown = np.pad(mask, 1), np.pad(centre, 1)
    h, w = plane.shape
    around = np.zeros((h, w))
    for dy, dx in ((1, 0), (1, 2), (0, 1), (2, 1)):
        around += np.where(inside[dy : dy + h, dx : dx + w], shown[dy : dy + h, dx : dx + w], centre)
    return np.where(mask, to_pixels(centre + amount * (4.0 * centre - around)), plane)


#: Fixed colours of labels, in turn.
PALETTE = np.array(
    [(230, 57, 70), (29, 53, 87), (42, 157, 143), (233, 196, 106), (244, 162, 97), (131, 56, 236), (0, 119, 182), (255, 183, 3), (106, 153, 78), (214, 40, 40), (58, 134, 255), (255, 0, 110)],
    np.uint8,
)
OTHER_LABEL = (55, 55, 55)


def label_colours(labels: np.ndarray, selected=None) -> np.ndarray:
    """RGB by label; with a selection, labels outside it are grey."""
    out = np.where((labels > 0)[..., None], PALETTE[(labels - 1) % len(PALETTE)], 0).astype(np.uint8)
    if selected is not None:
        out[(labels > 0) & ~np.isin(labels, list(selected))] = OTHER_LABEL
    return out


def label_greys(labels: np.ndarray) -> np.ndarray:
    return np.where(labels > 0, labels.astype(np.int64) * 37 % 255 + 1, 0).astype(np.uint8)


def overlay(plane: np.ndarray, mask: np.ndarray, colour=(255, 0, 0), alpha: float = 0.35) -> np.ndarray:
    """RGB of the plane with masked pixels blended with the colour."""
    grey = np.repeat(plane[..., None], 3, axis=2)
    mixed = to_pixels(grey * (1.0 - alpha) + np.array(colour, float) * alpha)
    return np.where(mask[..., None], mixed, grey)

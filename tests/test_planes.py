"""Functions of planes against plain loops, closed forms and known figures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from rasterloom.functions import kernels, planes

PLANES = hnp.arrays(np.uint8, st.tuples(st.integers(5, 12), st.integers(5, 12)))
RNG = np.random.default_rng(7)
PLANE = RNG.integers(0, 256, (17, 13)).astype(np.uint8)
GRADIENT = np.repeat((np.arange(512) // 2)[None, :], 512, axis=0).astype(np.uint8)

#: Known pictures: rows of a mask, then area, and second central moments of each component.
SIMPLE = """
..................
.###.......####...
.###.......####...
.###.......####...
.......#...####...
......###.........
.....#####........
......###.........
.......#..........
...###.......##...
...#.#.......##...
...###.......##...
"""
CHAINS = """
............
..#.....#...
...#...#....
....#.#.....
.....#......
"""
BRIDGES = """
..................
..###.......###...
..###.......###...
..#############...
..###.......###...
..###.......###...
..................
....###....###....
....###....###....
....###....###....
......######......
"""


def mask_of(text: str) -> np.ndarray:
    return np.array([[c == "#" for c in line] for line in text.split()])


def brute_windows(plane, mask, pick):
    h, w = plane.shape[0] - mask.shape[0] + 1, plane.shape[1] - mask.shape[1] + 1
    return np.array([[pick(sorted(plane[y : y + mask.shape[0], x : x + mask.shape[1]][mask].tolist())) for x in range(w)] for y in range(h)])


def test_rounding_is_half_away_from_zero():
    assert planes.to_pixels(np.array([0.5, 2.5, -0.5, 254.5, 300.0, 0.49999999999999994])).tolist() == [1, 3, 0, 255, 255, 0]


def test_noise_figures():
    noisy = planes.gaussian_noise(GRADIENT, 400.0, 1)
    assert np.mean((noisy.astype(float) - GRADIENT) ** 2) == pytest.approx(365.298858642578, abs=5e-12)
    assert np.array_equal(planes.gaussian_noise(PLANE, 0.0, 3), PLANE)


@pytest.mark.parametrize("probability", [0.0, 0.05, 0.5, 1.0])
def test_impulse_noise_draws_in_order(probability):
    u, at, wanted = planes._uniforms(5, 2 * PLANE.size), 0, []
    for v in PLANE.ravel():
        hit, at = u[at] < probability, at + 1
        if hit:
            v, at = (0 if u[at] < 0.5 else 255), at + 1
        wanted.append(v)
    assert planes.impulse_noise(PLANE, probability, 5).ravel().tolist() == wanted


def test_kernels():
    assert kernels.laplacian(3).tolist() == [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]
    assert kernels.laplacian(3, "eight") == pytest.approx(np.array([[-0.25, -0.5, -0.25], [-0.5, 3, -0.5], [-0.25, -0.5, -0.25]]))
    assert kernels.second_derivative(5) == pytest.approx([-1 / 12, 4 / 3, -5 / 2, 4 / 3, -1 / 12])
    assert abs(kernels.laplacian_of_gaussian(7, 1.4).sum()) < 1e-12 and kernels.laplacian_of_gaussian(7, 1.4)[3, 3] > 0
    assert kernels.gaussian(11, 1.8).sum() == pytest.approx(1)
    for bad in (lambda: kernels.average(2), lambda: kernels.laplacian(1), lambda: kernels.as_kernel([[1, 2]]), lambda: kernels.as_kernel([[math.nan]]), lambda: kernels.as_aperture([[0]]), lambda: kernels.as_aperture([[2]])):
        with pytest.raises(ValueError):
            bad()
    assert [kernels.rank_number(r, 4) for r in ("min", "median", "max", "1")] == [0, 2, 3, 1]
    with pytest.raises(ValueError):
        kernels.rank_number("4", 4)


@settings(max_examples=25, deadline=None)
@given(PLANES)
def test_identity_kernel_crops_and_mean_filters_agree(plane):
    identity = np.zeros((3, 3))
    identity[1, 1] = 1
    full = np.ones((3, 3), bool)
    assert np.array_equal(planes.to_pixels(planes.correlate(plane, identity)), plane[1:-1, 1:-1])
    assert np.array_equal(planes.trimmed_mean(plane, full, 0), planes.to_pixels(planes.correlate(plane, kernels.average(3))))
    assert np.array_equal(planes.trimmed_mean(plane, full, 8), planes.rank_filter(plane, full, 4))
    opened, closed = planes.morphology(plane, full, "opening"), planes.morphology(plane, full, "closing")
    assert (opened <= plane[2:-2, 2:-2]).all() and (closed >= plane[2:-2, 2:-2]).all()


@pytest.mark.parametrize("cells", [[[1, 1, 1]] * 3, [[0, 1, 0], [1, 0, 0], [0, 0, 1]], [[1] * 7] * 7, [[1]]])
def test_rank_filters_against_sorting(cells):
    mask = kernels.as_aperture(cells)
    n = int(mask.sum())
    for rank in {0, n // 2, n - 1}:
        assert np.array_equal(planes.rank_filter(PLANE, mask, rank), brute_windows(PLANE, mask, lambda v, r=rank: v[r]))
    if n > 2:
        assert np.array_equal(planes.trimmed_mean(PLANE, mask, 2), planes.to_pixels(brute_windows(PLANE, mask, lambda v: sum(v[1:-1]) / len(v[1:-1]))))
    with pytest.raises(ValueError):
        planes.trimmed_mean(PLANE, mask, 1)


def test_windows_larger_than_the_plane():
    with pytest.raises(ValueError):
        planes.correlate(PLANE[:2, :2], kernels.average(3))
    assert planes.correlate(PLANE[:3, :3], kernels.average(3)).shape == (1, 1)


def test_rotation_sizes_and_right_angles():
    assert planes.rotated_box(2250, 3000, 30)[2:] == (3449, 3724) and planes.rotated_box(2250, 3000, -45)[2:] == (3713, 3713)
    assert planes.rotated_box(1200, 1920, 30)[2:] == (2000, 2263) and planes.rotated_box(225, 225, 30)[2:] == (308, 308)
    for method in ("nearest", "bilinear", "bicubic"):
        assert np.array_equal(planes.rotate(PLANE, 0, method), PLANE)
    assert np.array_equal(planes.rotate(PLANE, 90, "nearest"), np.rot90(PLANE))
    with pytest.raises(ValueError):
        planes.rotate(PLANE, math.inf)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic"])
def test_rotation_against_a_loop(method):
    degrees, background = 33.0, 9
    left, top, h, w = planes.rotated_box(*PLANE.shape, degrees)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    rows, columns = PLANE.shape

    def at(y, x):
        return float(PLANE[y, x]) if 0 <= y < rows and 0 <= x < columns else float(background)

    def cubic(t):
        return [np.prod([(t - b) / (a - b) for b in (-1, 0, 1, 2) if b != a]) for a in (-1, 0, 1, 2)]

    wanted = np.empty((h, w), np.uint8)
    for r in range(h):
        for q in range(w):
            tx, ty = left + q + 0.5, top + r + 0.5
            x, y = tx * c - ty * s + columns / 2 - 0.5, tx * s + ty * c + rows / 2 - 0.5
            if method == "nearest":
                v = at(math.floor(y + 0.5), math.floor(x + 0.5))
            elif not (0 <= x <= columns - 1 and 0 <= y <= rows - 1):
                v = background
            else:
                fx, fy = math.floor(x), math.floor(y)
                if method == "bilinear":
                    wx, wy, taps = (1 - (x - fx), x - fx), (1 - (y - fy), y - fy), (0, 1)
                else:
                    wx, wy, taps = cubic(x - fx), cubic(y - fy), (-1, 0, 1, 2)
                v = sum(wx[i] * wy[j] * at(fy + b, fx + a) for i, a in enumerate(taps) for j, b in enumerate(taps))
            wanted[r, q] = planes.to_pixels(np.array([v]))[0]
    got = planes.rotate(PLANE, degrees, method, background)
    assert (np.abs(got.astype(int) - wanted) <= (method == "bicubic")).all() and (got != wanted).mean() < 0.01


def test_crop_and_pad_truncate_toward_zero():
    plane = np.arange(20, dtype=np.uint8).reshape(4, 5)
    assert planes.crop_or_pad(plane, 3, 2).tolist() == plane[0:3, 1:3].tolist()
    padded = planes.crop_or_pad(plane, 7, 8, 1)
    assert padded[1:5, 1:6].tolist() == plane.tolist() and padded.sum() == plane.sum() + 56 - 20


@pytest.mark.parametrize(
    ("text", "areas", "moments"),
    [
        (SIMPLE, [9, 16, 13, 8, 6], [(6, 6), (20, 20), (14, 14), (6, 6), (1.5, 4)]),
        (CHAINS, [1] * 7, [(0, 0)] * 7),
        (BRIDGES, [37, 24], [(798, 60), (250, 30)]),
    ],
)
def test_known_components(text, areas, moments):
    labels = planes.label_components(mask_of(text))
    found = []
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        found.append((((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum()))
    assert np.bincount(labels.ravel())[1:].tolist() == areas
    assert np.array(found) == pytest.approx(np.array(moments))


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9))))
def test_components_against_a_flood(mask):
    labels, seen, wanted = planes.label_components(mask), 0, np.zeros(mask.shape, int)
    for y, x in np.argwhere(mask):
        if wanted[y, x]:
            continue
        seen += 1
        front = [(y, x)]
        while front:
            a, b = front.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not wanted[a, b]:
                wanted[a, b] = seen
                front += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert np.array_equal(labels, wanted)


def test_zero_crossings_need_strict_signs():
    response = np.array([[1.0, 0.0, -1.0], [2.0, -2.0, 0.5]])
    assert planes.zero_crossings(response, 2.0).tolist() == [[0, 0, 0], [255, 255, 255]]
    assert planes.zero_crossing_threshold(response) == pytest.approx(3 * 6.5 / 24)


def test_masked_filters_against_loops():
    mask = np.zeros(PLANE.shape, bool)
    mask[2:9, 3:11] = True
    kernel, r = kernels.gaussian(5, 1.1), 2
    h, w = PLANE.shape
    blurred, sharp = PLANE.copy(), PLANE.copy()
    for y, x in np.argwhere(mask):
        taps = [(kernel[dy + r, dx + r], PLANE[y + dy, x + dx]) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 <= y + dy < h and 0 <= x + dx < w and mask[y + dy, x + dx]]
        blurred[y, x] = planes.to_pixels(np.array([sum(a * float(b) for a, b in taps) / sum(a for a, _ in taps)]))[0]
        centre = float(PLANE[y, x])
        around = [float(PLANE[b, a]) if 0 <= b < h and 0 <= a < w and mask[b, a] else centre for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))]
        sharp[y, x] = planes.to_pixels(np.array([centre + 0.35 * (4 * centre - sum(around))]))[0]
    assert np.array_equal(planes.masked_blur(PLANE, mask, kernel), blurred)
    assert np.array_equal(planes.masked_sharpen(PLANE, mask, 0.35), sharp)


def test_fourier():
    samples = RNG.normal(size=50)
    found = planes.fft_signal(samples)
    assert len(found) == 64 and (np.abs(found) ** 2).sum() / 64 == pytest.approx((samples**2).sum())
    assert planes.fft_plane(PLANE).shape == (32, 32) and planes.fft_plane(PLANE)[0, 0].real == pytest.approx(PLANE.sum())
    impulse = planes.signal_spectrum_image(np.eye(1, 8)[0], 16, 8)
    assert (impulse == 255).all()
    with pytest.raises(ValueError):
        kernels.next_power_of_two(0)


def test_pictures():
    plot = planes.signal_plot(np.array([0.0, 1.0, 0.0, -1.0]), 31, 21)
    assert plot[10, 0] == 255 and plot[0, 10] == 255 and plot[20, 30] == 255 and (plot[10] > 0).all()
    assert planes.signal_plot(np.zeros(3), 8, 5)[2].tolist() == [255] * 8
    counts = np.zeros(256, int)
    counts[3], counts[4] = 10, 1
    picture = planes.histogram_image(counts, 512, 256)
    assert (picture[:, 6] == 0).all() and (picture[:, 8] == 0).sum() == 26 and (picture[:, 0] == 255).all()
    with pytest.raises(ValueError):
        planes.histogram_image(counts, 255, 10)
    red = planes.overlay(np.full((1, 2), 100, np.uint8), np.array([[True, False]]))
    assert red.tolist() == [[[154, 65, 65], [100, 100, 100]]]

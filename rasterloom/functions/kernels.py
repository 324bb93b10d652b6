"""Kernels, apertures and other small parameters, built on the driver with NumPy."""

from __future__ import annotations

import math

import numpy as np


def as_kernel(values) -> np.ndarray:
    """A finite kernel of odd height and width."""
    kernel = np.asarray(values, float)
    if kernel.ndim != 2 or 0 in kernel.shape or not all(n % 2 for n in kernel.shape):
        raise ValueError("a kernel needs odd height and width")
    if not np.isfinite(kernel).all():
        raise ValueError("a kernel needs finite coefficients")
    return kernel


def as_aperture(cells) -> np.ndarray:
    """A mask of odd height and width with an active cell at least."""
    mask = np.asarray(cells)
    if mask.ndim != 2 or 0 in mask.shape or not all(n % 2 for n in mask.shape):
        raise ValueError("an aperture needs odd height and width")
    if not np.isin(mask, (0, 1)).all():
        raise ValueError("an aperture has cells 0 and 1 only")
    if not mask.any():
        raise ValueError("an aperture needs an active cell")
    return mask.astype(bool)


def _odd(size: int, least: int) -> int:
    if size < least or size % 2 == 0:
        raise ValueError(f"the kernel size must be odd and at least {least}")
    return size


def average(size: int) -> np.ndarray:
    return np.full((_odd(size, 1), size), 1.0 / (size * size))


def second_derivative(size: int) -> np.ndarray:
    """The stencil on -r..r whose moments are those of a second derivative: 2 at the second power, 0 elsewhere."""
    offsets = np.arange(size) - _odd(size, 3) // 2
    moments = np.zeros(size)
    moments[2] = 2.0
    return np.linalg.solve(np.vander(offsets.astype(float), size, increasing=True).T, moments)


def laplacian(size: int = 3, neighbours: str = "four") -> np.ndarray:
    """Positive at the centre; `eight` weighs the axes and the diagonals by a half each."""
    stencil, middle, places = second_derivative(size), size // 2, np.arange(size)
    out = np.zeros((size, size))
    if neighbours not in ("four", "eight"):
        raise ValueError("neighbours must be four or eight")
    axis = 1.0 if neighbours == "four" else 0.5
    out[middle, places] -= axis * stencil
    out[places, middle] -= axis * stencil
    if neighbours == "eight":
        out[places, places] -= 0.25 * stencil
        out[places, places[::-1]] -= 0.25 * stencil
    return out


def laplacian_of_gaussian(size: int, sigma: float) -> np.ndarray:
    """Positive at the centre, summing to zero."""
    if not (math.isfinite(sigma) and sigma > 0):
        raise ValueError("sigma must be finite and positive")
    d = np.arange(_odd(size, 3)) - size // 2
    q = (d[:, None] ** 2 + d[None, :] ** 2) / (2.0 * sigma * sigma)
    out = (1.0 - q) * np.exp(-q) / (math.pi * sigma**4)
    return out - out.mean()


def sharpening(size: int = 5, amount: float = 1.0) -> np.ndarray:
    if not (math.isfinite(amount) and amount >= 0):
        raise ValueError("the amount must be finite and not negative")
    out = amount * laplacian(size)
    out[size // 2, size // 2] += 1.0
    return out


def gaussian(size: int = 11, sigma: float = 1.8) -> np.ndarray:
    if not (math.isfinite(sigma) and sigma > 0):
        raise ValueError("sigma must be finite and positive")
    d = np.arange(_odd(size, 1)) - size // 2
    out = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2.0 * sigma * sigma))
    return out / out.sum()


def rank_number(rank: str | int, active: int) -> int:
    """A 0-based order statistic from its number, min, median (the upper one) or max."""
    named = {"min": 0, "median": active // 2, "max": active - 1}
    try:
        number = named[rank] if rank in named else int(rank)
    except (TypeError, ValueError):
        raise ValueError(f"no rank: {rank!r}") from None
    if not 0 <= number < active:
        raise ValueError(f"the rank must lie in 0..{active - 1}")
    return number


#: Accepted names of the morphological operations.
MORPHOLOGY = {"erosion": "erosion", "erode": "erosion", "dilation": "dilation", "dilate": "dilation", "opening": "opening", "open": "opening", "closing": "closing", "close": "closing"}


def next_power_of_two(n: int) -> int:
    if n < 1:
        raise ValueError("a size must be positive")
    return 1 << (n - 1).bit_length()

"""Morlet and Gaussian filters in the Fourier domain, and the schedules that place them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the filter design.
ALPHA = 5.0  # standard deviations of a filter that subsampling must keep
R_PSI = math.sqrt(0.5)  # height at which neighbouring filters cross
SIGMA0 = 0.1  # bandwidth of the low-pass of support 1
PERIOD_EPS = 1e-7
MOST_PERIODS = 5
SUPPORT_LOSS = 1e-3


def fftfreq(n: int) -> np.ndarray:
    return np.fft.fftfreq(n)


def periods(sigma: float, eps: float = PERIOD_EPS) -> int:
    """Frequency periods beyond which a Gaussian of this width is below eps."""
    return math.ceil(math.sqrt(-2 * sigma**2 * math.log(eps)) + 1)


def _folded(n: int, sigma: float, centre: float, grid: np.ndarray, p: int) -> np.ndarray:
    bell = np.exp(-((grid - centre) ** 2) / (2 * sigma**2))
    return bell.reshape(2 * p - 1, n).mean(axis=0)


def morlet(n: int, xi: float | None, sigma: float) -> np.ndarray:
    """Band-pass at xi without mean, or the low-pass for ``None``, of unit L1 norm in time."""
    p = min(periods(sigma), MOST_PERIODS)
    grid = (np.arange((2 * p - 1) * n) + (1 - p) * n) / n
    low = _folded(n, sigma, 0.0, grid if p > 1 else fftfreq(n), p)
    h = low
    if xi is not None:
        band = _folded(n, sigma, xi, grid, p)
        h = band - band[0] / low[0] * low
    back = np.fft.ifft(h)
    return h / np.sqrt(back.real**2 + back.imag**2).sum()


def gauss(n: int, sigma: float) -> np.ndarray:
    return morlet(n, None, sigma)


def sigma_psi(xi: float, q: int, r: float = R_PSI) -> float:
    f = 1 / 2 ** (1 / q)
    return xi * (1 - f) / (1 + f) / math.sqrt(2 * math.log(1 / r))


def xi_max(q: int) -> float:
    return max(1 / (1 + 2 ** (3 / q)), 0.35)


def subsampling(xi: float, sigma: float, alpha: float = ALPHA) -> int:
    """Largest j such that the filter may be subsampled by 2^j."""
    return math.floor(-math.log2(min(abs(xi) + alpha * sigma, 0.5))) - 1


def temporal_support(h: np.ndarray, loss: float = SUPPORT_LOSS) -> int | None:
    """Smallest N that loses at most this L1 mass outside [-N, N]; None where half the length is too little."""
    back = np.fft.ifft(h)[: len(h) // 2]
    tail = np.cumsum(np.sqrt(back.real**2 + back.imag**2)[::-1])[::-1]
    inside = np.flatnonzero(tail <= loss)
    return int(inside[0]) + 1 if len(inside) else None


def schedule(j: int, q: int) -> list[tuple[float, float]]:
    """(centre, width) from high to low: constant ratio down to the least width, then equal steps."""
    xi, least, step = xi_max(q), SIGMA0 / 2**j, 2 ** (1 / q)
    sigma = sigma_psi(xi, q)
    out = [(xi, sigma)] if sigma > least else []
    if not out:
        xi = sigma
    while out and sigma > least * step:
        xi, sigma = xi / step, sigma / step
        out.append((xi, sigma))
    elbow = xi
    for _ in range(q - 1):
        xi -= elbow / q
        out.append((xi, least))
    return out


def spun(j: int, q: int) -> list[tuple[float, float]]:
    base = schedule(j, q)
    return base + [(-xi, s) for xi, s in base]


@dataclass(frozen=True, eq=False)
class Filter:
    """A filter's response at full length; ``level(k)`` is the one for signals subsampled by 2^k."""

    xi: float
    sigma: float
    j: int
    h: np.ndarray

    def level(self, k: int) -> np.ndarray:
        return coarsen(self.h, 1 << k)


def coarsen(h: np.ndarray, k: int) -> np.ndarray:
    """Sum of the k blocks of a response."""
    return h.reshape(k, -1).sum(axis=0)


@lru_cache(maxsize=64)
def low_pass(n: int, support: float) -> Filter:
    sigma = SIGMA0 / support
    return Filter(0.0, sigma, subsampling(0.0, sigma), gauss(n, sigma))


@lru_cache(maxsize=64)
def bank(n: int, j: int, q: int, spin: bool = False) -> tuple[Filter, ...]:
    return tuple(Filter(xi, s, subsampling(xi, s), morlet(n, xi, s)) for xi, s in (spun if spin else schedule)(j, q))

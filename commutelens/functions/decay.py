"""Decay kernels: how much a job counts that is ``t`` minutes away."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gaussian sigmas named after the minute at which a job counts half.
SIGMAS = {
    "min15": 12.739827,
    "min30": 25.479655,
    "min45": 38.21948,
    "min60": 50.95931,
    "min75": 63.699135,
    "min90": 76.43896,
    "min105": 89.17879,
    "min120": 101.91862,
}
DEFAULT_SIGMA = SIGMAS["min60"]

Kernel = Callable[[Column], Column]


def gaussian(sigma: float | Column = DEFAULT_SIGMA, mu: float = 0.0) -> Kernel:
    """``exp(-(t-mu)^2 / (2 sigma^2))``: 1 at ``mu``, 0 at infinity."""

    def kernel(t: Column) -> Column:
        width = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
        gap = t.cast("double") - F.lit(float(mu))
        return F.exp(-(gap * gap) / (F.lit(2.0) * width * width))

    return kernel


def inverse() -> Kernel:
    """``1 / t``: infinite at 0, 0 at infinity."""

    def kernel(t: Column) -> Column:
        minutes = t.cast("double")
        return F.when(minutes == 0.0, F.lit(float("inf"))).otherwise(
            F.lit(1.0) / F.nullif(minutes, F.lit(0.0))
        )

    return kernel


def weighted(jobs: Column, kernel: Kernel, t: Column) -> Column:
    """``jobs * kernel(t)``; no jobs count 0 even where the kernel is infinite."""
    return F.when(jobs == 0, F.lit(0.0)).otherwise(jobs * kernel(t))


def sigma_for_half_life(minutes: float | Column) -> float | Column:
    """The Gaussian sigma under which a job ``minutes`` away counts half."""
    factor = math.sqrt(2.0 * math.log(2.0))
    return minutes / factor if not isinstance(minutes, Column) else minutes / F.lit(factor)

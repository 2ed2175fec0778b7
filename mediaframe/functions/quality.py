"""Image quality: sharpness and exposure of gray pixels, and the score formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The weights of sharpness, exposure, resolution and file size.
WEIGHTS = (0.45, 0.30, 0.15, 0.10)


def shrink(gray: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` pixels on the longer side, by averaging areas."""
    h, w = gray.shape
    scale = max(h, w) / most
    if scale <= 1:
        return gray
    rows, cols = max(1, round(h / scale)), max(1, round(w / scale))
    r, c = np.arange(rows + 1) * h // rows, np.arange(cols + 1) * w // cols
    sums = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), r[:-1], axis=0), c[:-1], axis=1)
    return np.rint(sums / (np.diff(r)[:, None] * np.diff(c)[None, :])).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float | None:
    """Population variance of the 4-neighbour Laplacian; None for fewer than 3 pixels on a side."""
    if min(gray.shape) < 3:
        return None
    g = gray.astype(np.float64)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def exposure_value(gray: np.ndarray) -> float | None:
    if not gray.size:
        return None
    bins = np.bincount(gray.ravel(), minlength=256)
    clipped = (bins[:5].sum() + bins[251:].sum()) / gray.size
    return float((0.6 * (1 - abs(gray.mean() - 128) / 128) + 0.4 * max(0.0, 1 - 5 * clipped)) * 100)


def _per_image(pixels: pd.Series, width: pd.Series, most: int, fn) -> pd.Series:
    out = []
    for p, w in zip(pixels, width, strict=True):
        ok = p is not None and w and len(p) and len(p) % int(w) == 0
        out.append(fn(shrink(np.asarray(p, np.uint8).reshape(-1, int(w)), most)) if ok else None)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Raw sharpness of row-major gray pixels, measured at no more than 800 pixels; null where there is none."""
    return _per_image(pixels, width, 800, laplacian_variance)


@F.pandas_udf(T.DoubleType())
def exposure(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Exposure from 0 to 100, measured at no more than 400 pixels."""
    return _per_image(pixels, width, 400, exposure_value)


def sharpness_score(raw: Column) -> Column:
    return F.least(F.coalesce(raw, F.lit(0.0)) / 20.0, F.lit(100.0))


def exposure_score(x: Column) -> Column:
    return F.coalesce(x, F.lit(50.0))


def resolution_score(width: Column, height: Column, most: Column) -> Column:
    """Against the group's largest; 50 without both sides or without any resolution in the group."""
    known = width.isNotNull() & height.isNotNull() & (most > 0)
    return F.when(known, F.least(width.cast("double") * height.cast("double") / most * 100.0, F.lit(100.0))).otherwise(50.0)


def size_score(size: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(size.cast("double") / most.cast("double") * 100.0, F.lit(100.0))).otherwise(50.0)


def total_score(sharp: Column, exposed: Column, resolution: Column, size: Column) -> Column:
    return sharp * WEIGHTS[0] + exposed * WEIGHTS[1] + resolution * WEIGHTS[2] + size * WEIGHTS[3]


def quick_score(sharp: Column, exposed: Column) -> Column:
    return sharp * 0.5 + exposed * 0.5

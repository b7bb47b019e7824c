"""Hashes of small grey images, given as flat arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side of the square image that is hashed and of the corner of low frequencies that is kept (fixed values).
SIDE, CORNER = 64, 16


def shrink(pixels: np.ndarray, side: int) -> np.ndarray:
    """A grey image as a square of ``side``: means of equal shares of its rows and columns."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        edges = np.linspace(0, n, side + 1)
        total = np.concatenate([np.zeros_like(np.take(pixels, [0], axis)), np.cumsum(pixels, axis=axis)], axis=axis)
        low = np.minimum(edges.astype(int), n)
        part = np.expand_dims(edges - low, 1 - axis)
        upto = np.take(total, low, axis) + part * (np.take(total, np.minimum(low + 1, n), axis) - np.take(total, low, axis))
        pixels = np.diff(upto, axis=axis) / (n / side)
    return pixels


def perceptual_hash(pixels: np.ndarray) -> np.ndarray:
    """Bits of a grey image: whether each low frequency lies above the median of their magnitudes."""
    low = np.fft.fft2(shrink(pixels.astype(float), SIDE))[:CORNER, :CORNER]
    middle = np.median(np.abs(low))
    # Complex numbers compare by their real parts first, then by the imaginary ones.
    return (low.real > middle) | ((low.real == middle) & (low.imag > 0))


@F.pandas_udf(T.StringType())
def image_hash(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Hexadecimal perceptual hash of flat rows of grey values; null where they aren't rows of that width."""

    def one(flat, w) -> str | None:
        if flat is None or not w or not len(flat) or len(flat) % int(w):
            return None
        bits = perceptual_hash(np.asarray(flat, float).reshape(-1, int(w)))
        return np.packbits(bits.reshape(-1)).tobytes().hex()

    return pd.Series([one(f, w) for f, w in zip(pixels, width)])

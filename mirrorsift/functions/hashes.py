"""Bit hashes: packing, Hamming similarity, and perceptual hashes of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def above(values: Column, level: Column) -> Column:
    """'1' for each value over the level, else '0', as text."""
    # the level is repeated, not named inside the function, where it would be computed anew for each value
    levels = F.array_repeat(level, F.size(values))
    return F.array_join(F.zip_with(values, levels, lambda x, y: F.when(x.cast("double") > y, F.lit("1")).otherwise(F.lit("0"))), "")


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)


def median_of(values: Column) -> Column:
    s = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def halves(bits: Column) -> tuple[Column, Column]:
    """Two longs of up to 32 bits each, so that no sign bit is touched."""
    part = lambda at: F.coalesce(F.conv(F.nullif(F.substring(bits, at, 32), F.lit("")), 2, 10).cast("long"), F.lit(0).cast("long"))
    return part(1), part(33)


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


#: Frames of a video whose comparison is written out.
UNROLLED = 32


def frame_similarity(a: Column, b: Column, bits_per_frame: int = 36, rows_per_frame: int = 6, denominator: str = "bits", most: int | None = None) -> Column:
    """Percent of equal bits of two arrays of frame hashes; 0 where their lengths differ or are 0.

    denominator 'rows' divides the differing bits by hash rows instead of bits, floored at 0.  most: no array is
    longer; up to ``UNROLLED`` the sum is written out, which Spark compiles, as it does no function over an array.
    """
    if denominator not in ("bits", "rows"):
        raise ValueError("denominator is 'bits' or 'rows'")
    if most is None or most > UNROLLED:
        differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    else:
        differ = F.lit(0)
        for i in range(most):
            differ = differ + F.when(F.size(a) > i, F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))).otherwise(F.lit(0))
    per_frame = bits_per_frame if denominator == "bits" else rows_per_frame
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (1 - differ / (F.size(a) * per_frame)) * 100))


# -- pixels ----------------------------------------------------------------------------------------


def _weights(n: int, m: int, kernel, support: float, smooth: bool = True) -> np.ndarray:
    """The m x n matrix that resamples n pixels to m; smooth widens the kernel where pixels are left out."""
    scale = n / m
    wide = max(scale, 1.0) if smooth else 1.0
    centre = (np.arange(m)[:, None] + 0.5) * scale
    at = np.arange(n)[None, :] + 0.5
    # the window of each output pixel is rounded to whole pixels
    low, high = np.floor(centre - support * wide + 0.5), np.floor(centre + support * wide + 0.5)
    inside = (at - 0.5 >= np.maximum(low, 0)) & (at - 0.5 < np.minimum(high, n))
    w = np.where(inside, kernel((at - centre) / wide), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _round(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling of an image (rows, columns and perhaps channels) of bytes, columns first."""
    across, down = _weights(image.shape[1], width, _lanczos, 3.0), _weights(image.shape[0], height, _lanczos, 3.0)
    return _round(np.tensordot(down, _round(np.moveaxis(np.tensordot(across, image, (1, 1)), 0, 1)), (1, 0)))


def shrunk(image: np.ndarray, width: int = 320, height: int = 240) -> np.ndarray:
    """A frame larger than width x height made to fit, by linear interpolation between the nearest pixels."""
    h, w = image.shape[:2]
    if w <= width and h <= height:
        return image
    scale = min(width / w, height / h)

    def sides(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (t, b, y), (left, right, x) = sides(h, max(1, int(h * scale))), sides(w, max(1, int(w * scale)))
    y, x = y.reshape(-1, *[1] * (image.ndim - 1)), x.reshape(1, -1, *[1] * (image.ndim - 2))
    rows = image[t] * (1 - y) + image[b] * y
    return _round(rows[:, left] * (1 - x) + rows[:, right] * x)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an image with red, green and blue channels; other images have one channel."""
    if image.ndim == 2 or image.shape[2] < 3:
        return image.reshape(*image.shape[:2], -1)[..., 0]
    # fixed values: the weights of red, green and blue in 65536ths
    return np.floor((image[..., 0] * 19595 + image[..., 1] * 38470 + image[..., 2] * 7471 + 32768) / 65536)


def average_bits(image: np.ndarray, side: int = 8) -> np.ndarray:
    small = resized(grey(image), side, side)
    return (small > small.mean()).ravel()


def dct_bits(image: np.ndarray, side: int = 8, factor: int = 4) -> np.ndarray:
    """Low frequencies of the cosine transform over their median."""
    n = side * factor
    k = np.arange(n)
    basis = np.cos(np.pi * np.outer(k[:side], 2 * k + 1) / (2 * n))
    low = basis @ resized(grey(image), n, n) @ basis.T
    return (low > np.median(low)).ravel()


def as_long(bits: np.ndarray) -> int:
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def _images(rows: pd.DataFrame):
    for h, w, c, data in zip(rows["height"], rows["width"], rows["n_channels"], rows["data"], strict=True):
        # the source has blue, green, red
        image = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c).astype(float)
        yield image[..., 0] if c == 1 else image[..., 2::-1]


def hash_pixels(rows: pd.DataFrame, side: int = 8) -> pd.DataFrame:
    """ahash and phash, of the image brought to 256 x 256, for rows of height, width, n_channels and data (bytes of Spark's image source)."""
    out = []
    for image in _images(rows):
        even = resized(image, 256, 256)
        out.append((as_long(average_bits(even, side)), as_long(dct_bits(even, side))))
    return pd.DataFrame(out, columns=["ahash", "phash"]).astype("int64")


def hash_frames(rows: pd.DataFrame, side: int = 6) -> pd.DataFrame:
    """phash of video frames; the small variant (side 6) shrinks large frames first."""
    out = [as_long(dct_bits(shrunk(image) if side == 6 else image, side)) for image in _images(rows)]
    return pd.DataFrame({"phash": np.array(out, dtype=np.int64)})

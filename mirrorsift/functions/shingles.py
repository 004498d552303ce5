"""MinHash band keys of texts, made a text at a time in Arrow batches: no shingle ever becomes a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a shingle of long texts and characters of one of short texts.
WORDS, CHARACTERS = 5, 8
#: Texts of fewer words are read by characters, texts of so many or more by words; in between by both, so that
#: two texts of like size share a reading.
SHORT, LONG = 60, 30
_BLOCK = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` ids; of the whole where there are fewer."""
    size = min(size, len(ids))
    n = len(ids) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * _BASE + ids[j : j + n]
    return np.unique(_mix(h))


def least_values(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of the hashes under each of the multiplicative orders."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(out, (hashes[at : at + _BLOCK, None] * factors).min(axis=0), out=out)
    return out


class Bands:
    """Keys of a text: a key for each band of ``rows`` minima, apart for the readings by words and by characters."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factors = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.known: dict[str, int] = {}

    def _word_ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1 << 20:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))

    def _keys(self, hashes: np.ndarray, reading: int) -> np.ndarray:
        least = least_values(hashes, self.factors).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(reading)
        for j in range(self.rows):
            key = _mix(key * _BASE + least[:, j])
        return key.view(np.int64)

    def __call__(self, text: str | None) -> list[int]:
        words = (text or "").lower().split()
        if not words:
            return []
        out = []
        if len(words) >= LONG:
            out.append(self._keys(runs(self._word_ids(words), WORDS), 0))
        if len(words) < SHORT:
            points = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            out.append(self._keys(runs(_mix(points.astype(np.uint64)), CHARACTERS), 1))
        return np.concatenate(out).tolist()


def band_keys(text: Column, bands: int, rows: int) -> Column:
    """The MinHash keys of a text; texts without words have none."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(texts: pd.Series) -> pd.Series:
        make = Bands(bands, rows)
        return pd.Series([make(t) for t in texts], dtype=object)

    return keys(text)

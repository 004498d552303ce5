"""Arrow UDFs for what built-in functions cannot express: sequence matching, NFKC, encodings."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, STEP, LONG = 500, 250, 1000
LEAST_RATIO = 0.3


def seq_ratio_text(a: str, b: str, autojunk: bool = True) -> float:
    """Percent of characters in matching blocks; the order of a and b matters."""
    return Matcher(b, autojunk).ratio(a) * 100


def positions(text: str) -> dict[str, int]:
    """A bit mask of the places of each character."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence with ``other`` of the text of these masks, a word of bits at a time."""
    full = (1 << size) - 1
    row = full
    for c in other:
        if c in masks:
            hit = row & masks[c]
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


class Matcher:
    """The ratio of difflib.SequenceMatcher(None, a, b) for one b and many a, equal to the last bit.

    difflib seeds blocks only with the characters that are rare in a long b, but looks at every character of a for
    each block; here the places of rare characters are listed once, and blocks are grown many characters at a time.
    Where all characters are seeds, the first longest block is found by searching b for ever longer pieces of a.
    """

    def __init__(self, b: str, autojunk: bool = True):
        self.b = b
        most = len(b) // 100 + 1 if autojunk and len(b) >= 200 else len(b)
        self.places: dict[str, list[int]] = {}
        for c in set(b):
            if b.count(c) <= most:
                at = self.places[c] = [b.find(c)]
                while (n := b.find(c, at[-1] + 1)) >= 0:
                    at.append(n)
        self.whole = sum(map(len, self.places.values())) == len(b)

    def matched(self, a: str) -> int:
        """Characters in matching blocks."""
        if self.whole:
            return self._matched_whole(a)
        b, places = self.b, self.places
        rows = [(i, places[c]) for i, c in enumerate(a) if c in places]
        starts = [i for i, _ in rows]
        total, todo = 0, [(0, len(a), 0, len(b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, size, last, runs = alo, blo, 0, -2, {}
            for at in range(bisect_left(starts, alo), bisect_left(starts, ahi)):
                row, found = rows[at]
                longer = {}
                for k in found:
                    if k < blo:
                        continue
                    if k >= bhi:
                        break
                    n = longer[k] = runs.get(k - 1, 0) + 1 if row == last + 1 else 1
                    if n > size:
                        i, j, size = row - n + 1, k - n + 1, n
                runs, last = longer, row
            while i - alo >= 16 and j - blo >= 16 and a[i - 16 : i] == b[j - 16 : j]:
                i, j, size = i - 16, j - 16, size + 16
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            p, q = i + size, j + size
            while ahi - p >= 16 and bhi - q >= 16 and a[p : p + 16] == b[q : q + 16]:
                p, q = p + 16, q + 16
            while p < ahi and q < bhi and a[p] == b[q]:
                p, q = p + 1, q + 1
            if p > i:
                total += p - i
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if p < ahi and q < bhi:
                    todo.append((p, ahi, q, bhi))
        return total

    def _matched_whole(self, a: str) -> int:
        find = self.b.find
        total, todo = 0, [(0, len(a), 0, len(self.b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, size = alo, 0
            for at in range(alo, ahi):
                if at + size >= ahi:
                    break
                while at + size < ahi and find(a[at : at + size + 1], blo, bhi) >= 0:
                    i, size = at, size + 1
            if size:
                total += size
                j = find(a[i : i + size], blo, bhi)
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + size < ahi and j + size < bhi:
                    todo.append((i + size, ahi, j + size, bhi))
        return total

    def ratio(self, a: str) -> float:
        size = len(a) + len(self.b)
        return 2.0 * self.matched(a) / size if size else 1.0


#: Bits of half a window and of a window: the top bit of each, which no character has, stops its carry.
_HALF, _LANE = 256, 512


class Windows:
    """The overlapping windows of a text, side by side in one integer: a probe meets all of them in one pass."""

    def __init__(self, text: str):
        self.texts = [text[i : i + CHUNK] for i in range(0, len(text), STEP)]
        n = len(self.texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        step, rest = np.divmod(np.arange(len(codes)), STEP)
        # each character is in the first half of a window and, after the first step, in the second half of the one before
        first = step * _LANE + rest
        order = np.argsort(codes, kind="stable")
        self.masks: dict[str, int] = {}
        bits = np.zeros(n * _LANE, dtype=bool)
        for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            at = first[own]
            second = at[at >= _LANE] - _HALF
            bits[at] = bits[second] = True
            self.masks[text[own[0]]] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            bits[at] = bits[second] = False
        self.full = int.from_bytes((b"\xff" * (_LANE // 8 - 1) + b"\x7f") * n, "little")
        self._matchers: dict[int, Matcher] = {}

    def common_lengths(self, probe: str) -> list[int]:
        """common_length() of the probe and each window."""
        full = row = self.full
        find = self.masks.get
        for c in probe:
            mask = find(c)
            if mask:
                hit = row & mask
                row = (row + hit | row - hit) & full
        found = (full ^ row).to_bytes(len(self.texts) * _LANE // 8, "little")
        return np.bitwise_count(np.frombuffer(found, dtype=np.uint64)).reshape(len(self.texts), _LANE // 64).sum(axis=1).tolist()

    def ranked(self, probe: str) -> list[tuple[float, int]]:
        """(bound, -i), the highest first: the probe's ratio to window i is at most its bound."""
        common = self.common_lengths(probe)
        return sorted(((2 * n / (len(probe) + len(w)), -i) for i, (n, w) in enumerate(zip(common, self.texts, strict=True))), reverse=True)

    def ratio(self, probe: str, i: int) -> float:
        if i not in self._matchers:
            self._matchers[i] = Matcher(self.texts[i])
        return self._matchers[i].ratio(probe)


#: Pairs come in runs of one second text.
_windows = lru_cache(maxsize=8)(Windows)

#: The order in which probes are met: those inside a text differ more than its ends.
_ORDER = (1, 3, 2, 4, 0)
#: Bounds that two texts of one language reach anyhow; windows under it are matched only if all probes ask for more.
_LIKELY = 0.6


def sampled_ratio_text(a: str, b: str, least: float = 0.0) -> float:
    """Mean over five probes of a of the best ratio to any window of b, in percent; 0 where it is under ``least``.

    Matching blocks make a common subsequence, so the longest one bounds a window's ratio: windows that cannot
    beat the best are not matched, and a pair is left once what its probes may still reach is under ``least``.
    """
    size = len(a)
    probes = [a[at : at + CHUNK] for at in (0, size // 4, size // 2, 3 * size // 4, max(0, size - CHUNK)) if at < size]
    if not probes or not b:
        return 0.0
    windows = _windows(b)
    same = set(windows.texts)
    most = [1.0] * len(probes)
    hopeless = least / 100 * len(probes) - 1e-9
    rest = []
    for k in _ORDER:
        if k < len(probes) and probes[k] not in same:
            ranked, top = windows.ranked(probes[k]), 0.0
            while ranked and ranked[0][0] > max(top, _LIKELY):
                top = max(top, windows.ratio(probes[k], -ranked.pop(0)[1]))
            most[k] = max(top, ranked[0][0]) if ranked else top
            if sum(most) < hopeless:
                return 0.0
            rest.append((k, top, ranked))
    for k, top, ranked in rest:
        for bound, i in ranked:
            if bound <= top:
                break
            top = max(top, windows.ratio(probes[k], -i))
        most[k] = top
        if sum(most) < hopeless:
            return 0.0
    value = sum(most) / len(most) * 100
    return value if value >= least else 0.0


def similarity_text(a: str | None, b: str | None, least: float = 0.0) -> float:
    """Percent similarity of two normalised texts; 0 where it is under ``least``."""
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < LEAST_RATIO:
        return 0.0
    if a == b:
        value = 100.0
    elif max(len(a), len(b)) > LONG:
        value = sampled_ratio_text(a, b, least)
    else:
        # no more characters match than both have
        both = (Counter(a) & Counter(b)).total()
        value = seq_ratio_text(a, b) if 2.0 * both / (len(a) + len(b)) * 100 >= least else 0.0
    value = max(0.0, min(100.0, value))
    return value if value >= least else 0.0


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([seq_ratio_text(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sampled_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sampled_ratio_text(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Percent similarity of two normalised texts, 0 where it is under ``least``; equal ones and hopeless lengths never reach Python."""

    @F.pandas_udf(T.DoubleType())
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity_text(p, q, least) for p, q in zip(x, y, strict=True)], dtype="float64")

    la, lb = F.length(a), F.length(b)
    close = F.least(la, lb) / F.greatest(la, lb) >= LEAST_RATIO
    empty = a.isNull() | b.isNull() | (la == 0) | (lb == 0)
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(100.0)).when(~close, F.lit(0.0)).otherwise(similarity(F.when(close, a), F.when(close, b)))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, single spaces, stripped, lower case."""
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().lower())


def encoding_of(head: bytes, whole: bool = False) -> str:
    """utf-8, gbk or latin-1; unless head is the whole content, a character cut at its end is forgiven."""
    if not head:
        return "utf-8"
    for cut in range(1 if whole else 4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                break
    for cut in range(1 if whole else 2):
        try:
            head[: len(head) - cut].decode("gbk")
            return "gbk"
        except UnicodeDecodeError:
            pass
    return "latin-1"


@F.pandas_udf(T.StringType())
def _encoding(head: pd.Series) -> pd.Series:
    return head.map(lambda b: encoding_of(bytes(b)))


def detect_encoding(content: Column, sample: int = 1024) -> Column:
    """The encoding of binary content from its first bytes; valid UTF-8 never reaches Python."""
    head = F.substring(content, 1, sample)
    valid = F.is_valid_utf8(head.cast("string"))
    return F.when(content.isNull(), F.lit(None)).when(valid, F.lit("utf-8")).otherwise(_encoding(F.when(~valid, head).otherwise(F.lit(b""))))

"""Approximate search of short titles in texts, by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str, masks: dict[str, int]) -> int:
    """Length of the longest common subsequence, by bit rows (Hyyro 2004); ``masks`` are the places of a's characters."""
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str, starts: Iterable[int] | None = None) -> float:
    """The best 200 * common / (lengths) of the shorter text with any stretch of the longer one that is no longer than it.

    With ``starts``, only stretches of ``b`` that begin there are tried, unless b is the shorter text.
    """
    if len(a) > len(b):
        a, b, starts = b, a, None
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    n, best = len(a), 0.0
    for start in range(1 - n, len(b)) if starts is None else starts:
        part = b[max(start, 0) : start + n]
        # stretches whose outer character does not occur cannot be the best
        if part[-1] not in masks and part[0] not in masks:
            continue
        best = max(best, 200.0 * common_length(a, part, masks) / (n + len(part)))
    return best


def _ratios(title: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else partial_ratio(a, b) for a, b in zip(title, text, strict=True)], dtype="float64")


#: Titles from this length on are met by pairs of characters, shorter ones by single characters.
PAIRS_FROM = 3


def _least_common(n: int, least: float) -> int:
    """How many of a title's n - 1 pairs of characters (of its characters, if it is shorter than PAIRS_FROM) a stretch of ``least`` holds.

    A stretch is no longer than the title. With L common characters its ratio is 2 L / (n + m), so that L >= r n / (2 - r); each
    character that the title loses costs two pairs, each one in between costs one. The cost is greatest for the least L, where no other characters fit in between.
    """
    r = least / 100
    share = r / (2 - r)
    if n < PAIRS_FROM:
        return math.ceil(n * share - 1e-9)
    return n - 1 - math.floor(n * (1 - (3 - 2 / r) * share) + 1e-9)


def _codes(text: str, q: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points if q == 1 else points[:-1] << 21 | points[1:]


def places(title: str, text: str, least: float) -> np.ndarray | None:
    """Where stretches of ``text`` that are as near to the title as ``least`` may begin; None if nowhere.

    Common pairs of characters of such a stretch lie at distances from their places in the title that
    differ by no more than the characters that are lost or come in between.
    """
    q = 2 if len(title) >= PAIRS_FROM else 1
    own, met, need = _codes(title, q), _codes(text, q), _least_common(len(title), least)
    width = math.floor(2 * len(title) * (1 - least / 100) + 1e-9)
    order = np.argsort(own, kind="stable")
    low, high = (np.searchsorted(own[order], met, side) for side in ("left", "right"))
    some = np.flatnonzero(high > low)
    if len(some) < need:
        return None
    count = (high - low)[some]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    shifts = np.sort(np.repeat(some, count) - order[np.repeat(low[some], count) + within])
    dense = np.flatnonzero(shifts[need - 1 :] - shifts[: len(shifts) - need + 1] <= width)
    if not len(dense):
        return None
    begin, end = shifts[dense] - width, shifts[dense + need - 1] + width
    new = np.concatenate([[True], begin[1:] > end[:-1]])  # both rise, so that what overlaps is one range
    last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
    return np.concatenate([np.arange(a, b + 1) for a, b in zip(begin[new], end[last], strict=True)])


def _found(title: str | None, text: str | None, least: float) -> float | None:
    if not title or not text:
        return None
    starts = None
    if len(text) >= len(title):
        starts = places(title, text, least)
        if starts is None:
            return None
        starts = [k for k in starts.tolist() if -len(title) < k < len(text)]
    ratio = partial_ratio(title, text, starts)
    return ratio if ratio >= least else None


def ratio_found(title: Column, text: Column, least: float = 85.0) -> Column:
    """How well a title is found in a text, from 0 to 100; null below ``least``."""

    def found(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_found(a, b, least) for a, b in zip(titles, texts, strict=True)], dtype="float64")

    return F.pandas_udf(found, "double")(title, text)


def first_part(text: Column, share: float = 0.5, extra: int = 500) -> Column:
    """The part of a page in which titles are searched."""
    return F.left(text, F.floor(F.length(text) * share).cast("int") + extra)


def title_ratio(title: Column, text: Column, share: float = 0.5, extra: int = 500) -> Column:
    """How well a title is found in the first part of a page, from 0 to 100, case aside."""
    return F.pandas_udf(_ratios, "double")(F.lower(title), F.lower(first_part(text, share, extra)))

"""Fuzzy string similarities over whole batches, as Arrow UDFs and as functions of two lists.

`ratio` is the normalised insert-delete similarity 200 * LCS / (len a + len b), 100 for two empty strings. The longest
common subsequence of all pairs of a batch runs side by side: a pair is a lane of 64 bits, a step takes one character of
every longer string. Equal pairs of a batch are scored once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that run side by side; they are dealt by length, so that none waits long for another.
LANES = 8192
_NONE_A, _NONE_B = np.uint32(0x110000), np.uint32(0x110001)  # beyond every character


def _grid(strings: Sequence[str], pad: np.uint32) -> np.ndarray:
    """Characters of each string, a row each."""
    width = max(map(len, strings), default=0)
    if not width:
        return np.full((len(strings), 1), pad, dtype=np.uint32)
    out = np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width).copy()
    out[np.arange(width)[None, :] >= np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))[:, None]] = pad
    return out


def _lcs_long(a: str, b: str) -> int:
    """Where the shorter string has more than 64 characters: one number as wide as it takes."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    n = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
    m = np.fromiter(map(len, long), dtype=np.int64, count=len(long))
    out = np.zeros(len(n), dtype=np.int64)
    for i in np.flatnonzero(n > 64):
        out[i] = _lcs_long(short[i], long[i])
    lanes = np.flatnonzero((n > 0) & (n <= 64))
    lanes = lanes[np.argsort(m[lanes], kind="stable")]
    bits = np.uint64(1)
    for at in range(0, len(lanes), LANES):
        own = lanes[at : at + LANES]
        x, y = _grid([short[i] for i in own], _NONE_A), _grid([long[i] for i in own], _NONE_B)
        x = np.pad(x, ((0, 0), (0, 64 - x.shape[1])), constant_values=_NONE_A)
        full = np.where(n[own] == 64, ~np.uint64(0), (bits << (n[own] % 64).astype(np.uint64)) - bits)
        row = full.copy()
        with np.errstate(over="ignore"):
            for j in range(y.shape[1]):
                places = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
                hit = row & places
                row = ((row + hit) | (row - hit)) & full
        out[own] = n[own] - np.bitwise_count(row).astype(np.int64)
    return out


def _lengths(strings: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))


def ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    total = _lengths(a) + _lengths(b)
    return np.where(total == 0, 100.0, 200.0 * lcs(a, b) / np.maximum(total, 1))


def token_sort_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    ordered = lambda s: " ".join(sorted(s.split()))
    return ratio([ordered(x) for x in a], [ordered(y) for y in b])


def token_set_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio among the common words, and the common words with either side's own; 100 if one side's words are
    all common; 0 if a side has none.

    Strings that begin alike share that beginning, so one subsequence is enough: that of the words of either side's own."""
    n, own = np.zeros((3, len(a)), dtype=np.int64), ([], [])
    sure = np.full(len(a), np.nan)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = set(x.split()), set(y.split())
        both = p & q
        left, right = " ".join(sorted(p - q)), " ".join(sorted(q - p))
        if not p or not q:
            sure[i] = 0.0
        elif both and (not left or not right):
            sure[i] = 100.0
        n[:, i] = sum(map(len, both)) + max(0, len(both) - 1), len(left), len(right)
        own[0].append(left)
        own[1].append(right)
    common, left, right = n
    gap = (common > 0).astype(np.int64)
    whole = 200.0 * (common + gap + lcs(*own)) / np.maximum(2 * (common + gap) + left + right, 1)
    inside = [np.where(common > 0, 200.0 * common / np.maximum(2 * common + 1 + side, 1), 0.0) for side in (left, right)]
    return np.where(np.isnan(sure), np.maximum(whole, np.maximum(*inside)), sure)


def partial_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio of the shorter string to a window of its length, or a shorter one at an end, of the longer."""
    out, owner, short, window = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if x in y:
            out[i] = 100.0 if x or not y else 0.0
            continue
        views = {y[max(0, j) : j + len(x)] for j in range(1 - len(x), len(y))}
        owner += [i] * len(views)
        short += [x] * len(views)
        window += views
    np.maximum.at(out, np.array(owner, dtype=np.int64), ratio(short, window))
    return out


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """0 to 1, with the usual prefix weight 0.1 over four characters where the Jaro similarity exceeds 0.7."""
    out = np.zeros(len(a))
    na, nb = _lengths(a), _lengths(b)
    out[(na == 0) & (nb == 0)] = 1.0
    lanes = np.flatnonzero((na > 0) & (nb > 0))
    lanes = lanes[np.argsort(na[lanes], kind="stable")]
    for at in range(0, len(lanes), LANES):
        own = lanes[at : at + LANES]
        x, y = _grid([a[i] for i in own], _NONE_A), _grid([b[i] for i in own], _NONE_B)
        la, lb = na[own], nb[own]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
        place = np.arange(y.shape[1])[None, :]
        taken, hit = np.zeros(y.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
        row = np.arange(len(own))
        for i in range(x.shape[1]):
            free = (y == x[:, i : i + 1]) & ~taken & (np.abs(place - i) <= reach)
            hit[:, i] = free.any(axis=1)
            first = free.argmax(axis=1)
            taken[row[hit[:, i]], first[hit[:, i]]] = True
        m = hit.sum(axis=1)
        packed = lambda grid, kept: np.take_along_axis(grid, np.argsort(~kept, axis=1, kind="stable"), axis=1)
        p, q = packed(x, hit), packed(y, taken)
        w = min(p.shape[1], q.shape[1])
        moved = ((p[:, :w] != q[:, :w]) & (np.arange(w)[None, :] < m[:, None])).sum(axis=1) // 2
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / np.maximum(m, 1)) / 3, 0.0)
        w = min(4, w)
        prefix = (x[:, :w] == y[:, :w]).cumprod(axis=1).sum(axis=1)
        out[own] = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return out


def distinct_pairs(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, list[str], list[str]]:
    """(code of each row, left and right sides of the distinct pairs by code)."""
    place: dict[tuple[str, str], int] = {}
    codes = np.fromiter((place.setdefault(pair, len(place)) for pair in zip(a, b, strict=True)), dtype=np.int64, count=len(a))
    return codes, [x for x, _ in place], [y for _, y in place]


def over_distinct(f: Callable, a: pd.Series, b: pd.Series) -> pd.Series:
    """f over the distinct pairs of a batch, dealt back to its rows; null where a side is null."""
    some = (a.notna() & b.notna()).to_numpy()
    codes, left, right = distinct_pairs(a[some], b[some])
    out = np.full(len(a), np.nan)
    if len(codes):
        out[some] = f(left, right)[codes]
    return pd.Series(out)


def _udf(f: Callable):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return over_distinct(f, a, b)

    return score


#: Column functions by name; a null side gives null.
UDFS = {f.__name__: _udf(f) for f in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)}

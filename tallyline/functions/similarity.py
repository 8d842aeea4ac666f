"""Name similarity: 2·LCS/(len a + len b), 1 for two empty names.

This is the ratio of the insert/delete distance.  Spark's ``levenshtein`` counts a
substitution as one step and gives other values, but it bounds the distance from
both sides (lev <= insert/delete distance <= 2*lev), so it decides most pairs inside
the JVM and only the rest go to the exact Arrow function, which works on a whole batch of pairs at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import col

WORD = 64
AT_ONCE = 4096  # pairs whose rows stay in a processor's cache


def _codes(flat: np.ndarray, lengths: np.ndarray, blank: int) -> np.ndarray:
    """Code points of names that follow each other in ``flat``, one row each, filled up with ``blank``."""
    out = np.full((len(lengths), int(lengths.max())), blank, dtype=flat.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _code_points(names: np.ndarray) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _match_bits(same: np.ndarray, words: int) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words, the first value in the lowest bit."""
    packed = np.packbits(same, axis=1, bitorder="little")
    out = np.zeros((len(same), words * 8), dtype=np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def _lcs_of_like_lengths(short: np.ndarray, long: np.ndarray, short_length: np.ndarray, long_length: np.ndarray) -> np.ndarray:
    """LCS lengths of pairs whose lengths are alike: one step for each character of the longer names, for all pairs together.

    A row of the recurrence is one bit for each character of the shorter name, in as many words as that takes; the sum of
    a step carries from word to word.
    """
    width = int(short_length.max())
    words = -(-width // WORD)
    a, b = _code_points(short), _code_points(long)
    if max(a.max(), b.max()) < 0xFE:
        a, b = a.astype(np.uint8), b.astype(np.uint8)
    top = np.iinfo(a.dtype).max
    a, b = _codes(a, short_length, top), _codes(b, long_length, top - 1)
    row = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for step in range(b.shape[1]):
        match = _match_bits(a == b[:, step:step + 1], words)
        if words == 1:
            row = (row + (row & match)) | (row & ~match)
            continue
        carry = np.zeros(len(a), dtype=np.uint64)
        for w in range(words):
            now = row[:, w]
            hit = now & match[:, w]
            first = now + hit
            total = first + carry
            carry = ((first < now) | (total < first)).astype(np.uint64)
            row[:, w] = total | (now & ~match[:, w])
    valid = _match_bits(np.arange(width) < short_length[:, None], words)
    return np.bitwise_count(~row & valid).sum(axis=1).astype(np.int64)


def lcs_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of two object arrays of texts, pair by pair."""
    la, lb = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    swap = la > lb
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    short_length, long_length = np.minimum(la, lb), np.maximum(la, lb)
    out = np.zeros(len(a), dtype=np.int64)
    # Pairs of like lengths run together, so that short names do not wait for long ones.
    shape = np.where(short_length == 0, -1, (short_length // 16) * (1 << 32) + long_length // 16)
    order = np.argsort(shape, kind="stable")
    starts = np.flatnonzero(np.diff(shape[order], prepend=-2))
    for part in np.split(order, starts[1:]):
        for few in np.split(part, range(AT_ONCE, len(part), AT_ONCE)) if len(part) and shape[part[0]] >= 0 else ():
            out[few] = _lcs_of_like_lengths(short[few], long[few], short_length[few], long_length[few])
    return out


def lcs_length(a: str, b: str) -> int:
    return int(lcs_lengths(np.array([a], dtype=object), np.array([b], dtype=object))[0])


def ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ratios of two object arrays of texts, pair by pair."""
    total = np.fromiter(map(len, a), dtype=np.int64, count=len(a)) + np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    return np.where(total == 0, 1.0, 2.0 * lcs_lengths(a, b) / np.maximum(total, 1))


def ratio_of(a: str, b: str) -> float:
    return float(ratios(np.array([a], dtype=object), np.array([b], dtype=object))[0])


@F.pandas_udf(T.DoubleType())
def _ratio_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[both] = ratios(a.to_numpy(dtype=object)[both], b.to_numpy(dtype=object)[both])
    return pd.Series(out).where(both, None)


def similarity(a: Column | str, b: Column | str) -> Column:
    """The exact ratio of two name columns."""
    return _ratio_arrow(col(a), col(b))


def may_reach(a: Column | str, b: Column | str, threshold: float) -> Column:
    """A cheap JVM test every pair with ratio >= threshold passes: length bound, then edit distance bound."""
    a, b = col(a), col(b)
    la, lb = F.length(a), F.length(b)
    total = la + lb
    slack = F.lit(1e-9)
    steps = F.floor(total * (1.0 - threshold) + slack).cast("int")
    length_ok = F.least(la, lb) * 2.0 >= total * threshold - slack
    return (total == 0) | (length_ok & (F.levenshtein(a, b) <= steps))

"""String similarities: set measures as native expressions, alignment measures as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tokens(text: Column) -> Column:
    """Distinct non-empty tokens."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), " ", -1), lambda w: w != ""))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams of the text without blanks; none if the text is shorter than n."""
    squeezed = F.regexp_replace(text, r"\s+", "")
    room = F.char_length(squeezed) - n + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), lambda i: F.substring(squeezed, i, F.lit(n)))
    return F.when((F.char_length(text) >= n) & (room >= 1), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct lists: both empty 1, one empty 0. The intersection is one common subexpression."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def dice(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(1.0))


def acronym(a: Column, b: Column) -> Column:
    """One text is the initials of the other's two or more tokens."""

    def initials(x: Column) -> Column:
        parts = F.filter(F.split(x, " ", -1), lambda w: w != "")
        return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))

    return F.coalesce(initials(a) == b, F.lit(False)) | F.coalesce(initials(b) == a, F.lit(False))


def letter_masks(a: str) -> dict[str, int]:
    """Where each character stands in the text, as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(at: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    v = full
    for c in b:
        m = at.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over arbitrary integers."""
    return _common(letter_masks(a), len(a), b) if a and b else 0


def ratio_of(a: str, b: str) -> float:
    """Normalised insert-delete similarity; 0 if either is empty."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows at the edges being shorter.

    A window's common letters (counted, whatever their order) bound its score, so most windows are passed over."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if short in long:
        return 1.0
    at = letter_masks(short)
    room = {c: mask.bit_count() for c, mask in at.items()}
    best, have, shared = 0.0, dict.fromkeys(room, 0), 0
    for i in range(1 - m, n):
        lo, hi = max(i, 0), min(i + m, n)
        if i + m <= n and (c := long[i + m - 1]) in room:  # enters
            have[c] += 1
            shared += have[c] <= room[c]
        if i > 0 and (c := long[i - 1]) in room:  # leaves
            shared -= have[c] <= room[c]
            have[c] -= 1
        if 2 * shared > best * (m + hi - lo):
            best = max(best, 2 * _common(at, m, long[lo:hi]) / (m + hi - lo))
    return best


def token_set_of(a: str, b: str) -> float:
    """Best ratio among shared tokens and shared tokens with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 1.0
    full_a, full_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(ratio_of(full_a, full_b), ratio_of(both, full_a), ratio_of(both, full_b))


def _batched(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            if (x, y) not in seen:
                seen[x, y] = score(x, y)
            out.append(seen[x, y])
        return pd.Series(out, dtype="float64")

    return run


def ratio(a: Column, b: Column) -> Column:
    return _batched(ratio_of)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _batched(partial_of)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _batched(token_set_of)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Ratio of the texts with their tokens sorted (sorting stays native)."""

    def ordered(x: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(x, F.lit("")), " ", -1), lambda w: w != "")), " ")

    return ratio(ordered(a), ordered(b))

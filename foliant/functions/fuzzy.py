"""Token-set similarity of two texts, 0 to 100, as an Arrow function over already joined pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel in the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(total: int, distance: int) -> float:
    return 100.0 * (1 - distance / total) if total else 100.0


def token_set(a: str, b: str) -> float:
    """The best of comparing the sets' common words and each side's rest; 0 if either text has no word.

    100 if one side's words hold the other's. Distance counts insertions and deletions.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    left, right = " ".join(only_x), " ".join(only_y)
    s = len(" ".join(both))
    gap = 1 if s else 0
    whole_x, whole_y = s + gap + len(left), s + gap + len(right)
    distance = len(left) + len(right) - 2 * common_length(left, right)
    scores = [ratio(whole_x + whole_y, distance)]
    if s:
        scores += [ratio(s + whole_x, gap + len(left)), ratio(s + whole_y, gap + len(right))]
    return max(scores)


@F.pandas_udf(T.IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whole-number similarity; null or blank on either side gives 0."""
    return pd.Series([int(token_set(x, y)) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype="int32")

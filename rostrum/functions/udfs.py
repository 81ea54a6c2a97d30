"""The few functions that no built-in expresses, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_within(a: str | None, b: str | None, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; -1 beyond `most`."""
    if a is None or b is None or abs(len(a) - len(b)) > most:
        return -1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return -1
        before, row = row, new
    return row[-1] if row[-1] <= most else -1


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([osa_within(x, y, int(m)) for x, y, m in zip(a, b, most)])


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility form without marks, for letters that the folding table lacks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

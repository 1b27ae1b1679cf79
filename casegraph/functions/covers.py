"""The shortest stretch of a text that covers most of a query's terms."""

from __future__ import annotations

import sys
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Workers receive these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COVER = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])


@F.pandas_udf(COVER)
def best_cover(places: pd.Series, terms: pd.Series, longest: pd.Series) -> pd.DataFrame:
    """First token and length of the best cover: most terms, then shortest, then first.

    ``places`` are the tokens with asked words in order, ``terms`` those of each. One pass with two
    ends: a window starts at a hit and reaches as far as ``longest`` tokens; its cover ends where
    its last new term first occurs.
    """
    out = []
    for at, held, most in zip(places, terms, longest, strict=True):
        best, end = (0, 0, 0), 0
        coming: dict[str, deque] = {}
        for i in range(len(at)):
            while end < len(at) and at[end] < at[i] + most:
                for t in held[end]:
                    coming.setdefault(t, deque()).append(int(at[end]))
                end += 1
            firsts = [q[0] for q in coming.values() if q]
            size = max(firsts) - int(at[i]) + 1
            best = max(best, (len(firsts), -size, -int(at[i])))
            for t in held[i]:
                coming[t].popleft()
        out.append((-best[2], -best[1]))
    return pd.DataFrame(out, columns=["start", "length"])

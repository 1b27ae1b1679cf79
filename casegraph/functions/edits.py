"""Edit distance with swapped neighbours, for candidate pairs only; pairs of one size are measured together."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Workers receive these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def edits(a: str, b: str) -> int:
    """The least number of insertions, deletions, replacements and swaps of neighbours, text in between allowed."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            row, swap = row_of.get(y, 0), column
            if x == y:
                column = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[row][swap] + (i - row - 1) + 1 + (j - swap - 1))
        row_of[x] = i
    return table[-1][-1]


FEW = 8  # pairs of one size below this are measured one by one
CELLS = 1 << 22  # characters, or entries of a table, that are held at a time


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts in rows, filled up with zeros, and their lengths."""
    sizes = np.fromiter(map(len, texts), dtype="int64", count=len(texts))
    held = np.zeros((len(texts), int(sizes.max(initial=0))), dtype="uint32")
    held[np.arange(held.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="uint32")
    return held, sizes


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``edits`` of rows of equal sizes, cell by cell for all of them."""
    n, (rows, columns) = np.arange(len(a)), (a.shape[1], b.shape[1])
    table = np.full((rows + 2, columns + 2, len(a)), rows + columns, dtype="int32")
    table[1:, 1] = np.arange(rows + 1)[:, None]
    table[1, 1:] = np.arange(columns + 1)[:, None]
    row_of = np.zeros((columns, len(a)), dtype="int64")  # where the letter of a column was met last
    for i in range(1, rows + 1):
        column = np.zeros(len(a), dtype="int64")
        for j in range(1, columns + 1):
            same = a[:, i - 1] == b[:, j - 1]
            row, swap = row_of[j - 1], column
            least = np.minimum(table[i, j] + ~same, np.minimum(table[i + 1, j], table[i, j + 1]) + 1)
            table[i + 1, j + 1] = np.minimum(least, table[row, swap, n] + (i - row - 1) + 1 + (j - swap - 1))
            column = np.where(same, j, column)
        row_of[a[:, i - 1] == b.T] = i
    return table[-1, -1]


def edits_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``edits`` of each pair. What both begin or end with costs nothing and is left out."""
    found = np.zeros(len(a), dtype="int32")
    longest = max(map(len, [*a, *b]), default=0)
    step = max(1, CELLS // max(longest, 1))
    for first in range(0, len(a), step):
        xs, ys = a[first:first + step], b[first:first + step]
        (x, size_x), (y, size_y) = _letters(xs), _letters(ys)
        shorter = np.minimum(size_x, size_y)
        at = np.arange(int(shorter.max(initial=0)))
        begin = _run((x[:, :len(at)] == y[:, :len(at)]) & (at < shorter[:, None]))
        back = [np.take_along_axis(v, np.maximum(size[:, None] - 1 - at, 0), axis=1) for v, size in ((x, size_x), (y, size_y))] if len(at) else [x[:, :0], y[:, :0]]
        end = _run((back[0] == back[1]) & (at < (shorter - begin)[:, None]))
        left_x, left_y = size_x - begin - end, size_y - begin - end
        kinds, kind = np.unique(left_x * (longest + 1) + left_y, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        for k, code in enumerate(kinds.tolist()):
            of_x, of_y = divmod(code, longest + 1)
            rows = order[bounds[k]:bounds[k + 1]]
            if not of_x or not of_y:
                found[first + rows] = of_x + of_y
            elif len(rows) < FEW:
                found[first + rows] = [edits(xs[r][begin[r]:begin[r] + of_x], ys[r][begin[r]:begin[r] + of_y]) for r in rows.tolist()]
            else:
                some = max(1, CELLS // ((of_x + 2) * (of_y + 2)))
                for c in range(0, len(rows), some):
                    r = rows[c:c + some]
                    found[first + r] = _table(
                        np.take_along_axis(x[r], begin[r][:, None] + np.arange(of_x), axis=1), np.take_along_axis(y[r], begin[r][:, None] + np.arange(of_y), axis=1))
    return found


def _run(same: np.ndarray) -> np.ndarray:
    """How many values each row begins with that are true."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if same.shape[1] else np.zeros(len(same), dtype="int64")


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(edits_of_pairs(a.tolist(), b.tolist()), dtype="int32")

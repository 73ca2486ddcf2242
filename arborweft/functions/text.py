"""Text expressions and small Arrow functions that have no built-in counterpart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: bytes, b: bytes, most: int) -> int:
    """Distance of optimal string alignment (edits and swaps of neighbours, no part edited twice), or -1 beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return -1
    old: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], old[j - 2] + 1)
        if min(row) > most:
            return -1
        old, prev = prev, row
    return prev[-1] if prev[-1] <= most else -1


def osa_udf(query: str, most: int):
    """Arrow function: distance of each text to the query, both in lower case and by bytes; -1 beyond `most`."""
    q = query.lower().encode()

    @F.pandas_udf("int")
    def run(names: pd.Series) -> pd.Series:
        memo = {n: -1 if n is None else osa(q, n.lower().encode(), most) for n in names.unique()}
        return names.map(memo).fillna(-1).astype("int32")

    return run


def glob_regex(glob: str) -> str:
    """A file glob (* ? [..], no match across '/') as an anchored regular expression."""
    out = ""
    for c in glob:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-" else "\\" + c if not c.isalnum() and c != "_" else c
    return f"^{out}$"


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])

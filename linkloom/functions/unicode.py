"""The three functions that Spark has no expression for, as Arrow UDFs.

Text that is ASCII already never needs the first two; it is passed over as null.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# workers get these functions with the plan: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASCII = r"^[\x00-\x7F]*$"


def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _fold(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    known: dict[tuple[str, str], float] = {}  # copies make the same two texts meet again and again
    out = []
    for x, y in zip(a, b):
        if (v := known.get((x, y))) is None:
            v = known[x, y] = 0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
        out.append(v)
    return pd.Series(out, dtype="float64")


def _unless_ascii(c: Column, f) -> Column:
    udf = F.pandas_udf(f, "string")
    return F.coalesce(udf(F.when(~c.rlike(ASCII), c)), c)


def nfkc(c: Column) -> Column:
    return _unless_ascii(c, _nfkc)


def ascii_fold(c: Column) -> Column:
    """Decomposed, combining marks dropped."""
    return _unless_ascii(c, _fold)


def sequence_ratio(a: Column, b: Column) -> Column:
    """difflib's ratio of a and b, in that order; 0 if either is empty."""
    return F.pandas_udf(_ratio, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))

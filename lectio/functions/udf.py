"""V1: a user's Python row function over a column, the slow path.

The reference applies Python lambdas row by row (``Series.apply``).  Every
function this engine needs is a built-in expression; this wrapper is for a
user's own function that no built-in can express.  It runs as a
``pandas_udf``: Arrow batches, one Python call per value inside the batch,
no per-row JVM round trip.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def row_function(fn: Callable, return_type: str = "string", null_result=None) -> Callable[..., Column]:
    """Wrap ``fn(value) -> result`` as a column function; nulls map to
    ``null_result`` without calling ``fn``."""
    @F.pandas_udf(return_type)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: null_result if v is None else fn(v))
    return apply

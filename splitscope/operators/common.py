"""Small DataFrame building blocks shared by the report operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd


def share_of(n: str | Column, *partition_cols: str, digits: int = 2) -> Column:
    """``ROUND(n * 100.0 / SUM(n) OVER (PARTITION BY cols), digits)``.

    Only ever applied to already aggregated rows (a handful per partition key), so an
    empty ``partition_cols`` (one window partition) is cheap.
    """
    n = F.col(n) if isinstance(n, str) else n
    w = Window.partitionBy(*partition_cols)
    return rnd(n.cast("double") * F.lit(100.0) / F.sum(n).over(w).cast("double"), digits)

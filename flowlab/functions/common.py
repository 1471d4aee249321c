from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c, n: int) -> Column:
    """Exact integer division (Spark ``div``), never through a double."""
    return F.call_function("div", as_col(c), F.lit(n))


def fresh(columns, name: str) -> str:
    """``name``, lengthened until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

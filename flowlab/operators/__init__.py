"""Operators: lazy DataFrame -> DataFrame steps built from Spark expressions,
joins and aggregates."""

from . import aggregates, detectors, filters, joins, quantiles, rangejoin, setops, sorts, summary, windows

__all__ = ["aggregates", "detectors", "filters", "joins", "quantiles", "rangejoin", "setops",
           "sorts", "summary", "windows"]

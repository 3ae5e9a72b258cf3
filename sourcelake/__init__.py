"""Analytics over tables of source files, on Spark."""

from sourcelake.plans.pipeline import CorpusAnalysis, analyze

__all__ = ["CorpusAnalysis", "analyze"]

"""driftpool: batch acquisition and longitudinal evaluation on Spark DataFrames."""

from driftpool.operators.selectors import select_class_balanced_margin, select_global_margin

__all__ = ["select_class_balanced_margin", "select_global_margin"]

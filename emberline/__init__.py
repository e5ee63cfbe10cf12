"""Wildfire danger, exposure, vulnerability and risk on Spark DataFrames.

A raster is a table of cells ``(row, col, value...)`` beside a small driver-side
:class:`~emberline.grid.GridSpec`; weather is a table of station-days.  Every
operator takes and returns DataFrames and leaves the physical plan to Spark.
"""

import sys

from pyspark import cloudpickle

from emberline.grid import GridSpec, Layer

# Functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["GridSpec", "Layer"]

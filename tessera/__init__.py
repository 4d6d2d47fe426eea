"""tessera: grid-spatial and entity-state analytics on Spark DataFrames.

Sub-packages:
  functions/  column helpers (rounding, integer division, safe series)
  sources/    table loading and the fixture world derived from the driver tables
  operators/  raster, sight, camera, spatial, state, report operators
  plans/      the registry of runnable queries and their DuckDB oracles
  streaming/  Structured Streaming jobs
"""

import sys as _sys

from tessera.params import StateParams, ViewParams, WorldParams


def _pickle_by_value() -> None:
    """Python functions of this package that run inside tasks (pandas folds,
    stateful stream functions) are shipped by value, so executors need no copy of
    the package on their import path."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
        pass


_pickle_by_value()

__all__ = ["StateParams", "ViewParams", "WorldParams"]

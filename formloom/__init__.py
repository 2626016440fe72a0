"""formloom - document-template analytics on Spark.

A *document* is one row holding an ordered array of structural elements; a
*template* is what the documents of one group have in common.  Everything here
takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

# Arrow UDFs defined here travel to the executors by value, so a cluster needs no
# copy of this package on its workers.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Semantic retrieval on Spark: chunk, embed, search, re-rank and keep points in step.

Every public operator takes and returns DataFrames.  The few steps that need
Python run on Arrow batches inside tasks; their code travels with the plan, so
executors need numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

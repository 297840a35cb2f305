"""quiver: nearest-neighbour analytics on Spark DataFrames of embedding vectors.

Vectors are ``array<float>`` columns. Every search takes a whole query set as a
DataFrame and returns one long table ``(qid, id, d, rk)``; indexes are ordinary
Parquet tables built and searched by Spark jobs.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels and data-source classes are pickled by value, so executors run them
# without quiver being installed or importable on their side.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from quiver.session import get_session, scratch_dir  # noqa: E402,F401

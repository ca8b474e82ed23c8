"""subjex: controlled-vocabulary subject indexing and ensemble ranking on Spark.

Every operator is a ``DataFrame -> DataFrame`` function so that Spark plans,
shuffles, spills and scales the work.
"""

import sys as _sys

__version__ = "0.1.0"

try:  # ship the package's Python functions with each task (no install on executors)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

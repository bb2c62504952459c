"""abundance: ecological survey analytics (MaxN, true zeros, habitat cover,
relief, count models) as lazy Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame``; column names
are parameters; missing-value handling is an explicit argument.
"""

import sys as _sys

# Code shipped to Python workers (mapInPandas / pandas UDF bodies and the
# package helpers they call) is pickled by value, so executors need no
# installed copy of this package.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass

from abundance.session import get_spark, checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"

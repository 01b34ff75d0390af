"""runlens: experiment-result and text-classification analytics as Spark jobs.

Every public function takes and returns DataFrames (or builds Columns); none
holds a global session, collects data to the driver, or loops over rows.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python UDFs (NFKC, t distribution) are shipped to the Python workers
# by value, so executors need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

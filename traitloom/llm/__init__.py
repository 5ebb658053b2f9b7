"""Operators for preparing training text at scale.

Everything here works on DataFrames with a text column; nothing outside this
subpackage imports it.  Functions shipped to Python workers are pickled by
value, and broadcasts hold plain data only (dicts, lists, arrays), so executors
need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

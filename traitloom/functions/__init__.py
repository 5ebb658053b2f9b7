"""Column functions, and functions under SQL names.

What runs in Python workers is pickled by value, so executors need no copy of
the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators: DataFrame in, DataFrame out.

The Python code that runs inside tasks is sent along with them, so the executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

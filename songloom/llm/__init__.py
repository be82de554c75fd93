"""Operators of a training-data pipeline: documents in, documents or verdicts out.

Nothing else of the library imports this package. The code that runs inside tasks is sent
along with them, as in ``songloom.operators``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

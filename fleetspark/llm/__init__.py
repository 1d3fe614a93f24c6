"""Operators for large-scale training text: scoring, deduplication, tokens, URLs.

Importing the package fills ``QUERIES`` and ``ORACLES``.  Functions that run in
Python workers are sent by value, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from fleetspark.llm.queries import ORACLES, QUERIES  # noqa: E402, F401

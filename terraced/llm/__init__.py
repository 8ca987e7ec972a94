"""Operators for preparing training corpora. Nothing else in the package imports this folder.

Functions that run inside tasks travel with the task, so executors need numpy and
pandas but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

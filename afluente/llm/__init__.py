"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get these modules with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

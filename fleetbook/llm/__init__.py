"""Operators for large training corpora: archives, tokenising, mixing, quality, deduplication,
scoring and chat formatting.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

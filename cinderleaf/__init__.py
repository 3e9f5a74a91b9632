"""Spark operators for text corpora, place and food catalogs, request logs and evaluation tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: dedup, extraction, filters, tokenising, scoring. Nothing outside imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

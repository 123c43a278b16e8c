"""Operators for preparing training text; nothing else in the library needs them."""

import sys

from pyspark import cloudpickle

# Tasks carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines over a table of documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with the plan, so that executors need
# nothing but numpy, pyarrow and xxhash; the package itself need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

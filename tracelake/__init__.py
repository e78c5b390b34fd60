"""tracelake: forensic log analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to Python workers by value, so executors need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

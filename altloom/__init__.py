"""altloom: alternative-text data work as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so that executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

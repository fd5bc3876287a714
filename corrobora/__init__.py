"""Evidence analytics over tables: passages, retrieval, claim checks, conflicts and rated answers on Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

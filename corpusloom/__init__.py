"""corpusloom: a PySpark-native engine for text collections and the evidence-backed graphs derived from them."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

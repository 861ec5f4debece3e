"""A PySpark-native engine for graph-shaped data: SPARQL, graph analytics, rules and training-data operators.

Functions that run on executors are pickled by value, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

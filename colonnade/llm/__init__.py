"""Training-data operators: mixing, sharding, deduplication, decontamination, scoring, extraction, formatting.

Nothing else in the library imports this subpackage.  Its functions are shipped to the executors by value,
so that executors need not have the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: packing, quality, deduplication, mixing, text extraction.

Every operator is a function from DataFrames to a DataFrame with its own
parameters; ``queries`` applies them to the given tables.  Python runs inside
Spark tasks only (``mapInArrow`` / ``applyInArrow``); Spark partitions,
shuffles and joins.  Nothing else in the library imports this package.

The package is shipped to Python workers by value, so executors need no copy
of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A PySpark-native engine for grouping near-identical items and judging how trustworthy the groups are."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel with the tasks that call them, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])

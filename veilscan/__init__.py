"""Content screening and its evaluation as Spark jobs over tables of texts, tool calls and run steps."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions used inside tasks travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

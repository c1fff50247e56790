"""Document-hierarchy analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship Python helpers with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Research-corpus mining as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

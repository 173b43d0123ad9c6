"""Spark-native mining, cleaning, retrieval and scoring of code-change data."""
import sys

from pyspark import cloudpickle

# helpers run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

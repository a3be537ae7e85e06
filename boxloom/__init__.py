"""Annotation analytics on Spark: images and their detections as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a job runs wherever its
# driver can import the package; nothing has to be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""hourspark: hourly-count analytics, feature building and pedestrian-graph jobs on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel with the task, so executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

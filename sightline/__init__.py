"""sightline: media-similarity analytics as declarative Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value, so that a cluster
# needs no installation of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

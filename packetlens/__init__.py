"""packetlens: network-traffic analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to the Python workers with their code, so executors
# (and the workers of stateful streaming queries, which read no --py-files) need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

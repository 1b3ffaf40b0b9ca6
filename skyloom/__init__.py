"""Sky, weather and feed analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

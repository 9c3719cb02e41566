"""Earth-observation analytics as Spark tables: catalogue, search, rasters, features."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Python functions that run in tasks travel with the plan, so the package
# does not have to be installed on the executors.
register_pickle_by_value(sys.modules[__name__])

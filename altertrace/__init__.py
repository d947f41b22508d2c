"""Event-log analytics and counterfactual traces as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

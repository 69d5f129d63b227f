"""discframe: disc-catalog and timeline analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from discframe.session import configure, session

# Step functions travel to the workers inside the plan, so executors need no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "session"]
__version__ = "0.1.0"

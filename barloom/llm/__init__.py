"""Operations a training-data pipeline needs, as Spark jobs.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries.  Functions that run inside tasks are sent to the
executors by value, so a cluster needs no copy of this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

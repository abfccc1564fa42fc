"""evalloom: evaluation and curation tables as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
on the driver except tables whose size is fixed or checked first.
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

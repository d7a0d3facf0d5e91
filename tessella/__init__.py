"""Content-operations analytics on Spark: composable DataFrame functions with column-role parameters.

Tasks get the code of this package with the job, so a cluster needs no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Tasks get the code of this subpackage with the job, so a cluster needs no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators that prepare large text corpora for model training, as Spark jobs.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""swellframe: ocean-wave model validation as Spark DataFrame jobs.

Every public function takes DataFrames (or a session and a path) and returns a DataFrame;
nothing is collected unless a docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

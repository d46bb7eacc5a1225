"""Operators for large training-data pipelines, one module each.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline, and their registered queries."""

import sys

from pyspark import cloudpickle

# The code of tasks travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

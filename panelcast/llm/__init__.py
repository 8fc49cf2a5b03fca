"""Operators for training-data pipelines: one module each, and their queries.

Tasks get these functions with the job (cloudpickle takes the whole package by
value), so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

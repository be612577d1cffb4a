"""Operators for preparing training text: one module per operator.

Every operator takes DataFrames, selects the columns it names before anything else (further
columns of any name are never read), and returns a DataFrame. Functions that run in Python
workers travel with the job, so executors need this package's dependencies, not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

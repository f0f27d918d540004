"""Operators of a training-data pipeline over tables of documents. Nothing else imports this package."""

import sys

from pyspark import cloudpickle

# the functions of this package travel to the workers with each job; nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

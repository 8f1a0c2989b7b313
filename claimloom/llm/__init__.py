"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers get the functions themselves, so a cluster needs no copy of this package.
register_pickle_by_value(sys.modules[__name__])

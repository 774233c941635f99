"""Registered queries over the given tables, each with its SQL twin."""

import sys

from pyspark import cloudpickle

# As in the library: functions sent to workers carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Satchel: per-project retrieval memory expressed as Spark jobs.

Documents and source files are chunked, hashed, embedded and kept in a keyed
table; whole batches of questions are answered with joins, windows and
partial top-k over that table.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

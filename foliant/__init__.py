"""Document analytics on Spark: sections, tables, search, export layout and reports."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their own code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

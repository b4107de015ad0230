"""Training-data operators: scoring, near copies, token counts, mixing, token files."""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry this package's code, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

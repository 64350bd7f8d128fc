"""Operators for preparing training text: filters, de-duplication, extraction, archives, token files."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the job: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Message triage, text-corpus curation and classifier evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

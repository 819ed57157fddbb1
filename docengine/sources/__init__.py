"""Readers: tables, office files as parts, templates. Only the zip adapter runs Python, batch by batch."""

import sys

from pyspark import cloudpickle

# The adapter's functions travel to the executors by value, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

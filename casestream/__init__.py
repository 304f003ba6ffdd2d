"""casestream: case entries, documents, subscribers and chats as DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel inside their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

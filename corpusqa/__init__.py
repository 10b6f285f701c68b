"""Spark jobs for retrieval and statistics over a corpus of question documents.

Every operator takes DataFrames and returns a DataFrame. Functions that run
inside Python workers are pickled by value, so a job submitted from a notebook
or another directory does not need this package installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

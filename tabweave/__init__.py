"""Spark-native preparation, modelling and evaluation of tabular and image data.

Every operator takes DataFrames and returns DataFrames; fitted state is either a
small set of parameters (bounded by the number of columns or classes) or a
Spark ML ``PipelineModel``.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

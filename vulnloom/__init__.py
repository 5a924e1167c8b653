"""Security analytics over a corpus of source repositories, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: the few Python functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""PySpark-native profiling, preparation, training and explanation of tables with a two-valued target."""
import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so the workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

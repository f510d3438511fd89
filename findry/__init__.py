"""findry: document retrieval, dataset building and retrieval evaluation on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to the executors carry their code along, so the package need
# not be installed on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""glyphmill: Spark jobs that clean, reconcile and mine machine-read text."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors with their code, so workers need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

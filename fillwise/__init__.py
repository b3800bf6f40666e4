"""Supply-chain analytics as DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

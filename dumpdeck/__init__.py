"""Turn database dumps into Spark tables and work with them at scale."""

import sys

from pyspark import cloudpickle

from dumpdeck.session import build_session

# Functions that run in tasks travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]

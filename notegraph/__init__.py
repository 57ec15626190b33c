"""notegraph: claim-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from notegraph.session import get_session  # noqa: E402

__all__ = ["get_session"]
__version__ = "0.1.0"

"""Scale scoring and prediction evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from scalemetrics.spec import FIVE_DOMAIN, ScaleSpec

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FIVE_DOMAIN", "ScaleSpec"]

"""Groundwork: evidence-grounding pipelines and training-data operators as Spark DataFrame transformations."""

import sys

import pyspark.cloudpickle as _cloudpickle

# Functions travel with their code: executors need not have this repository on their path.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators on tables of articles. :mod:`words` runs inside Python workers and is pickled by value,
so executors only need numpy and pyarrow, not this package on their path."""

from pyspark import cloudpickle as _cloudpickle

from corpuslab.operators import words as _words

_cloudpickle.register_pickle_by_value(_words)

"""Topic models. The modules whose functions run inside Python workers are pickled by value,
so executors only need numpy and pandas, not this package on their path."""

from pyspark import cloudpickle as _cloudpickle

from corpuslab.models import blocks as _blocks
from corpuslab.models import content as _content
from corpuslab.models import em as _em
from corpuslab.models import estep as _estep
from corpuslab.models import prevalence as _prevalence
from corpuslab.models import residuals as _residuals
from corpuslab.models import spectral as _spectral

for _m in (_blocks, _content, _estep, _em, _prevalence, _residuals, _spectral):
    _cloudpickle.register_pickle_by_value(_m)

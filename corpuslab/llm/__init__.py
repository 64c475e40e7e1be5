"""Operators of a training-data pipeline. Modules whose functions run inside Python workers are
pickled by value, so executors need numpy, pyarrow and the named libraries but not this package on their path."""

from pyspark import cloudpickle as _cloudpickle

from corpuslab.llm import bpe, conversation_repair, decontaminate, graph, langid, lm, logistic, metric_join, ngram_join, packing, quality, ranked_search, sharding, shared, textops, token_counts, toxicity

for _m in (bpe, conversation_repair, decontaminate, graph, langid, lm, logistic, metric_join, ngram_join, packing, quality, ranked_search, sharding, shared, textops, token_counts, toxicity):
    _cloudpickle.register_pickle_by_value(_m)

"""Operators of a training-data pipeline: archives, URL rules, vector search,
text joins and deduplication, classifiers, tokenizers. Nothing else in the
library imports this subpackage."""

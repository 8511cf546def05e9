"""Training-data operators: token output, similarity joins, mixing, language
models, quality rules and classifiers, packing, toxicity and pseudonyms.

Nothing outside this package imports it.
"""

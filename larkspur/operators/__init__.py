"""Operators over DataFrames: n-grams, sparse features, learners, evaluation, images."""

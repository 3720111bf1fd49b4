"""Operators for training data: near neighbours, clusters, balanced samples, packing, mixing, languages."""

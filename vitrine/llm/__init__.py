"""Matching, grouping, packing and labelling operators for training data; nothing outside this package imports it."""

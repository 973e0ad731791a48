"""Operators for building training data from large text collections. Nothing else in the package imports this one."""

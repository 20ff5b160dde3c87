"""Operators for training text and samples. Nothing else in the package imports this one."""

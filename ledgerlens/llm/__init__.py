"""Operators for training data and free text; nothing else in the library imports this subpackage."""

"""Operators for preparing training data from scholarly documents. Nothing else in the library imports this."""

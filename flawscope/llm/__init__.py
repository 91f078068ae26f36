"""Operators for building training data from large document tables.

Each module holds one operator with a general DataFrame interface; ``queries.py`` registers
one thin ``opN_<name>`` query per operator.  Nothing else in the library imports this package.
"""

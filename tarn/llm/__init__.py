"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator keeps a general interface in its own module;
``queries`` holds the thin ``opN_<name>`` queries over the standard tables.
"""

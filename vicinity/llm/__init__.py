"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may import the
library's general helpers (reading tables, the shared checkpoint folder).
"""

"""Training-data operators: thirteen DataFrame operators for large text corpora.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""

"""Corpus operators for training-data pipelines.

Nothing else in the package imports this subpackage.  Every operator is a
function from DataFrame to DataFrame; :mod:`lathe.llm.queries` holds the thin
queries over the standard tables.
"""

"""Operators for preparing text corpora: quality, licences, duplicates, leaks, chat, packing and pages.

Nothing else in the package imports this subpackage. Operators take and return DataFrames; the modules
``queries`` and ``oracles`` hold the registered queries and the SQL that they are compared with.
"""

"""Operators for preparing training corpora. Nothing outside this package imports it.

Every operator takes the documents as a DataFrame and returns a DataFrame; ``registry``
holds the registered queries.
"""

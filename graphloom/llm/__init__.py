"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries``
derives the fixed digest columns of the ``opN_*`` queries from them.
Nothing outside this package imports it.
"""

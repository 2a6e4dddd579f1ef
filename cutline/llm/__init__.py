"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
binds them to the ``documents`` and ``benchmark`` tables.
"""

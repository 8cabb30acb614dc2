"""Operators for preparing language-model training text at scale.

Nothing else in the library imports this subpackage; its queries are in
``reviewlab.llm.queries`` and its fixed inputs are the tables ``documents``,
``embeddings``, ``pages``, ``benchmark``, ``labels`` and ``conversations``.
"""

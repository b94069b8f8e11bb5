"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage; it can be removed
together with ``corpus_pipeline.py`` and ``tests/llm``.
"""

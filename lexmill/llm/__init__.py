"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; it stands alone and can be
removed together with ``tests/llm`` and ``corpus_pipeline.py``.
"""

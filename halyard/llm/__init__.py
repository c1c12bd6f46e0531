"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; deleting it (with
``tests/llm`` and ``corpus_pipeline.py``) leaves the rest working.
"""

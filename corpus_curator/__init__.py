"""corpus_curator: corpus rating, tagging, editing prompts and sampling as
PySpark DataFrame operators."""

__version__ = "0.1.0"

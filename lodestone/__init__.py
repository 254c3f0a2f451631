"""Lodestone: embedding analytics and vector search expressed as Spark plans.

``lodestone.functions``: vector arithmetic, prompts and statistics as columns; ``lodestone.operators``: exact indexes,
forests, evaluation, tokenizer and encoder; ``lodestone.sources``: model files, index files, record corpora;
``lodestone.streaming``: appending from streams; ``lodestone.plans``: the registered queries.
"""

__version__ = "0.1.0"

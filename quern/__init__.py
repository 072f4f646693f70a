"""Quern: a Spark-first engine for text-corpus curation and model-evaluation analytics."""

"""Operators that prepare text for training language models, as Spark DataFrame operators."""

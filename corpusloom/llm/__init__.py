"""Operators that prepare text and code corpora for the training of language models."""

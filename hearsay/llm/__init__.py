"""Operators for text corpora of language models; nothing else in the library imports this part."""

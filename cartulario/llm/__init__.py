"""Operators for text corpora of language models; nothing outside this subpackage imports it."""

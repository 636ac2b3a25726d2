"""Operators for text corpora and language-model data; nothing outside imports them."""

"""Operators that prepare text for the training of language models; nothing else in the library imports them."""

"""Operators for text that goes into or comes out of language models. Nothing outside this folder imports it."""

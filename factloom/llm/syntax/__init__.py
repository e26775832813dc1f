"""Grammars and the parser that runs them."""

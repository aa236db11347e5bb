"""Symbols, dependencies and calls from source text: Python by its own parser, other languages by a lexer and rules."""

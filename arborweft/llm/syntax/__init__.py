"""Packrat parsing-expression grammars for six languages."""

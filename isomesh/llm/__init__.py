"""Operators for building training corpora; nothing else in isomesh imports this."""

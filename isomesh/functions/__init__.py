"""Part of isomesh."""

"""Compositions of operators: whole recordings in, result tables out."""

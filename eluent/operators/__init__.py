"""Relational operators on long tables of signals, peaks and cells."""

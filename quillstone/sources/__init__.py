"""Readers and writers with the contracts of the run directory."""

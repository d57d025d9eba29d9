"""Incremental batches and their streaming form."""

"""Readers and projections from evidence tables to typed rows."""

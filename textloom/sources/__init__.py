"""Readers of dictionaries, captures and containers."""

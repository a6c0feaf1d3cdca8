"""Streaming of finlode."""

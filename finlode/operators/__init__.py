"""Operators of finlode."""

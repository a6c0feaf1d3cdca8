"""Functions of finlode."""

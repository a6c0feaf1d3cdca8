"""Sources of finlode."""

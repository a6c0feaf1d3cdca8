"""Plans of finlode."""

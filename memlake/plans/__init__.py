"""Plans of the memory lake."""

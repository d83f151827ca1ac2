"""Sources of the memory lake."""

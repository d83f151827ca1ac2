"""Functions of the memory lake."""

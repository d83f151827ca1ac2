"""Operators of the memory lake."""

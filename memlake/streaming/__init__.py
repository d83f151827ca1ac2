"""Streaming of the memory lake."""

"""Streams of the library."""

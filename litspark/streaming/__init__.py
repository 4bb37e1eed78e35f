"""Streams over landed pages, records and runs."""

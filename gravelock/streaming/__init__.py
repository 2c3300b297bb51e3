"""Ranking graphs that arrive on a stream."""

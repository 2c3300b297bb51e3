"""Readers and writers of graphs and data sets."""

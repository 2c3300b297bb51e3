"""Operators on tables of graphs."""

"""Relational operators: windows, flows, graphs, statistics, similarity, search."""

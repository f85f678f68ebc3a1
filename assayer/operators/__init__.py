"""Relational operators: graphs, intervals, windows, history, clones."""

"""Compositions: sequences to graphs, graphs to record vectors, vectors to an evaluation report."""

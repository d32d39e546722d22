"""Relational, graph, interval, similarity and scoring operators; each takes and returns DataFrames."""

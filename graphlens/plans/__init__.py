"""Whole plans: the cascade from files to a graph, and the job around it."""

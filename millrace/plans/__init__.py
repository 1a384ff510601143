"""Whole workloads and the query registry."""

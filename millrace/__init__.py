"""Preparation of panels of many time series, and of text corpora, as Spark jobs."""
